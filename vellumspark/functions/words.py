"""Word lists, phrases and patterns of the rules. Patterns are given for Java; \\s and \\w are written out where engines differ."""

# Letters, digits and underscore in any script, as Python's \w
W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"

FOOTER_WIKI = ["tham khảo", "liên kết ngoài", "chú thích", "đọc thêm"]
FOOTER_STEM = ["tham khảo", "liên kết ngoài", "chú thích", "đọc thêm", "nguồn", "xem thêm", "thư mục", "bài liên quan"]
CITATION = r"\[(?:\d+|cần dẫn nguồn|citation needed)\]"
CITATION_DIGITS = r"\[\d+\]"

# Content flags
MATH_STEM = [r"[+\-*/=<>^]{1,2}\s*\d|\d\s*[+\-*/=<>^]", r"\d+/\d+|\d+\^\d+|√\d+|\d+²|\d+³"]
FORMULA_STEM = [r"\$|\\(?:frac|int|sum|sqrt|alpha|beta|gamma|pi|infty)\{?", r"[∑∫√±≠≤≥×÷∞αβγπ]"]
FORMULA_ASSIGN = r"[A-Z]\s*=\s*[A-Za-z0-9²³√]"
LIST_ITEM = r"[\-\*•]\s+[^\n]+|\d+\.\s+[^\n]+"
LEGAL_STEM = [r"điều\s+\d+", r"khoản\s+\d+", r"chương\s+[ivx]+", r"bộ\s+luật\s+" + W, r"nghị\s+định\s+\d+", r"thông\s+tư\s+\d+"]
MATH_SUB = r"[+\-*/=<>^]{1,2}\s*\d|\d\s*[+\-*/=<>^]|\d+/\d+|√\d+|\$|\\frac"
LEGAL_SUB = r"(?:điều|khoản|chương)\s+\d+|bộ\s+luật|nghị\s+định"
TIMELINE = ["Niên biểu", "Sự kiện", "năm"]

# Domains and categories
STEM_DOMAIN = ["toán", "vật_lý", "hóa_học", "sinh_học", "tin_học", "kỹ_thuật", "công_thức", "phương_trình", "định_lý"]
LEGAL_DOMAIN = ["luật", "pháp", "điều", "nghị_định", "thông_tư", "bộ_luật", "hiến_pháp", "quy_định"]
STEM_DOMAIN_SUB = ["toán", "lý", "hóa", "sinh", "tin", "công nghệ", "kỹ thuật", "khoa học"]
LEGAL_DOMAIN_SUB = ["luật", "nghị định", "pháp luật", "hiến pháp", "thông tư"]
CATEGORY_SHORT = {"Toán học": "Toán", "Vật lý": "Lý", "Hóa học": "Hóa", "Sinh học": "Sinh", "Kinh tế học": "Kinh tế", "Tin học": "Tin"}

# Critical questions
CRITICAL = [
    "luật", "nghị định", "thông tư", "phạt", "tội", "án", "hiến pháp", "cơ quan", "thẩm quyền", "quy định",
    "năm nào", "khi nào", "bao nhiêu", "số lượng", "tỉ lệ", "%", "lần đầu", "đạt mốc",
    "tính", "công thức", "hàm số", "lãi suất", "khấu hao", "dao động", "trung bình", "sin", "cos",
    "theo đoạn", "trong văn bản", "ý nào sau đây", "chi tiết nào", "theo ngữ cảnh",
]

# Sensitive questions
HARD_BAN = ["khiêu dâm", "làm tình", "ấu dâm", "kích dục", "cá độ", "lật đổ chính quyền", "sex", "xxx"]
SOFT_BAN = ["giết", "ma túy", "vũ khí", "bạo lực", "chết", "tự tử", "biểu tình", "đình công", "khủng bố", "nghe trộm"]
WHITELIST = [
    "luật", "nghị định", "lịch sử", "kháng chiến", "tác hại", "phòng chống", "xét xử", "tòa án", "bộ luật", "quy định", "chính sách",
    "sinh học", "động vật", "thực vật", "loài", "săn bắn", "môi trường",
    "thế giới", "quốc tế", "tổng thống", "nhiệm kỳ", "pháp", "mỹ", "cuba",
    "đảng", "nhà nước", "chính phủ", "công đoàn", "tổ chức",
]

# Routers
ACADEMIC = ["đoạn thông tin", "title:", "content:", "văn bản", "theo đoạn"]
SILENCE_SUSPICIOUS = ["chế tạo", "làm giả", "lật đổ", "sex", "giết", "phản động", "trốn", "lách", "cấm"]
DIRTY = ["khiêu dâm", "ấu dâm", "loạn luân", "sex", "porn", "xxx"]
BAD_INTENT = r"(?:cách|làm sao|trốn|tránh|lách)[^\n]*(?:cá độ|ma túy|làm giả|trốn thuế)"
INTENT_OVERRIDE = [r"(?:cách|làm sao)[^\n]*(?:trốn|tránh|lách|qua mặt|làm giả)[^\n]*(?:thuế|luật|công an)", r"(?:tiếp tục)[^\n]*(?:hoạt động)[^\n]*(?:bị cấm)"]
MATH_HINT = r"\$|\\frac|\\int|\\sum"
BLOCK_PHRASES = ["tôi không thể", "không thể cung cấp", "không thể chia sẻ"]

# Refusal options
SAFETY_PATTERNS = [
    r"^(?:tôi|hệ thống)\s*không\s*(?:thể|được|hỗ trợ)\s*(?:trả lời|cung cấp)",
    r"vi phạm\s+(?:pháp luật|chính sách)",
    r"không\s+(?:thể|hỗ trợ)[^\n]*(?:làm giả|trốn thuế|gian lận)",
]
SAFETY_EXCLUSIONS = ["được xem là", "bị coi là", "cấu thành tội"]
NO_INFO_PATTERNS = [
    r"không\s+(?:có|đủ|tìm thấy)\s+(?:thông tin|dữ liệu)",
    r"không\s+thể\s+(?:xác định|kết luận|tính toán)(?:\.|,|\s|$)",
    r"thông tin[^\n]*không\s+đủ",
]
NO_INFO_EXCLUSIONS = ["không thể thay đổi", "không thể tách rời", "không thể thiếu", "không thể phủ nhận"]
NO_INFO_SKIP = ["vi phạm", "luật"]
NO_INFO_WIDE_PATTERNS = [
    r"(?:không|chưa) (?:có|đủ|tìm thấy) (?:thông tin|dữ liệu|dữ kiện|cơ sở|căn cứ|bằng chứng|giả thiết)",
    r"(?:thông tin|dữ liệu|dữ kiện|giả thiết)[^\n]* (?:không|chưa) (?:đủ|rõ ràng|chính xác)",
    r"không thể (?:xác định|kết luận|tính toán|trả lời|khẳng định|đưa ra|so sánh)(?:\.|,| |$)",
    r"(?:từ|dựa vào|với|căn cứ)[^\n]* (?:thông tin|dữ liệu|dữ kiện)[^\n]* (?:không|chưa|khó)",
    r"câu hỏi (?:không thể|không có) (?:trả lời|đáp án)",
]
NO_INFO_WIDE_EXCLUSIONS = [
    "tôi không thể", "không thể thay đổi", "không thể tách rời", "không thể thiếu", "không thể phủ nhận",
    "không thể tránh khỏi", "không thể đảo ngược", "không thể chia cắt", "không thể nhầm lẫn",
]
NO_INFO_WIDE_SKIP = ["vi phạm", "luật", "chính sách"]
ALL_ABOVE = [r"tất cả[^\n]*(?:đáp án|ý|lựa chọn)", r"cả[^\n]*(?:đều|là)[^\n]*đúng", r"các ý trên đều", r"phương án[^\n]*cả"]

# Answers
ANSWER_STRICT = [r"###\s*đáp án[:\s]*([a-z])", r"đáp án[:\s]*([a-z])", r"chọn[:\s]*([a-z])", r"kết luận[:\s]*([a-z])", r"^([a-z])\.$", r"^([a-z])$"]
ANSWER_LOOSE = [r"(?:đáp án|chọn|là)[:\s\*\-\.\[\(]*([a-z])[\]\)\*\.]", r"\*\*([a-z])\*\*", r"(?:^|\n)([a-z])[\.\)]"]
UNITS = r"m/s|km/h|kg|mol|j|w|v|a|°c|%"
CHANGE_WORDS = ["tăng", "giảm", "chênh lệch", "thay đổi"]
MOST_WORDS = ["lớn nhất", "cao nhất", "tối đa"]
LEAST_WORDS = ["nhỏ nhất", "thấp nhất", "tối thiểu"]

# Four-class router
FOUR_HARD_BAN = [
    "khiêu dâm", "làm tình", "ấu dâm", "kích dục", "cá độ", "cờ bạc", "lật đổ", "phản động", "khủng bố", "giết người",
    "tự sát", "tự tử", "chế bom", "chế súng", "ma túy đá", "thuốc lắc", "sex", "xxx",
]
FOUR_SOFT_BAN = ["ma túy", "vũ khí", "bạo lực", "chết", "biểu tình", "chính trị"]
FOUR_WHITELIST = [
    "luật", "nghị định", "quy định", "lịch sử", "tôn giáo", "kinh thánh", "torah", "qur'an", "văn bản", "cổ đại",
    "hình phạt", "tội danh", "theo đoạn văn", "dựa vào thông tin", "theo ngữ cảnh",
]
FOUR_MATH = r"\$|\\frac|\\int|\\sum|\^\{|sin\(|cos\(|tan\(|log\(|lim_|\\sqrt"
FOUR_STEM = [
    "giá trị của", "kết quả phép tính", "nghiệm của", "xác suất", "tọa độ", "đạo hàm", "tích phân", "trung bình cộng",
    "phương sai", "độ lệch chuẩn", "vận tốc", "gia tốc", "cường độ", "điện trở", "nồng độ", "số mol", "diện tích",
    "thể tích", "chu vi", "bán kính", "kỳ vọng", "đầu tư", "lợi nhuận", "mức lỗ", "thua lỗ", "lãi suất", "vốn",
    "tăng trưởng", "tỉ lệ", "phần trăm",
]
FOUR_CALCULATE = "tính"
FOUR_NOT_CALCULATE = ["tính cách", "tính chất", "tính năng", "tính nhân văn", "máy tính", "thuộc tính"]
FOUR_LOGIC = [
    "giả sử", "nếu... thì", "suy ra", "logic", "người tiếp theo", "quy luật", "mâu thuẫn", "tương phản",
    "ý nào sau đây đúng", "nguyên nhân chính", "dựa vào thông tin", "theo đoạn văn", "ý chính", "kết luận nào",
]

# Statutes
STATUTE_GARBAGE = ["Tải về", "Mục lục", "Về đầu trang"]

MARKER_INSIDE = r"(?<=[^\n])(?=Điều \d+|CHƯƠNG|MỤC|PHẦN)"
STATUTE_GARBAGE_WIDE = ["Tải về", "Mục lục", "Về đầu trang", "Quảng cáo", "In bài viết", "Copy thành công"]

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Line and link filters of crawled pages
GARBAGE_LINES = ["quảng cáo", "xem thêm", "tải về", "mục lục", "bản in", "trang chủ", "vietjack", "bình luận", "theo dõi chúng tôi"]
DENIED_LINKS = ["facebook", "youtube", "#"]

DENIED_LINKS_OF_LISTS = ["print", "javascript", "#", "download", "jpg", "png"]
DETAIL_LINKS = ["chi-tiet", "handle"]
SITE_GARBAGE = ["ads", "quangcao", "box-lien-quan", "bottom-mobile", "tool-bar"]
SITE_LINKS = ["Tải về", "Xem thêm"]
SITE_TAGS = ["script", "style", "noscript", "iframe", "button", "input"]

# Checks of replies
NOT = "không"
INFORMATION = "thông tin"

# Older router
RESCUE = ["hồ chí minh", "bác hồ", "đảng", "cách mạng", "chiến tranh", "kháng chiến", "lịch sử"]
NO_RESCUE = ["khiêu dâm", "sex", "porn", "lật đổ", "khủng bố", "xuyên tạc", "bôi nhọ"]
INTENT_OVERRIDE_OLD = [
    r"(?:cách|phương pháp)[^\n]*(?:vi phạm|trốn|tránh|lách)",
    r"tránh[^\n]*(?:cung cấp|khai báo)[^\n]*thông tin",
    r"tiếp tục[^\n]*hoạt động[^\n]*(?:bị đình chỉ|bị cấm)",
]

# Older heuristics
NEGATIVE_WORDS = ["không", "ngoại trừ", "sai", "trừ"]
REFUSAL_REPLIES = ["không có thông tin", "không tìm thấy", "không được đề cập", "không đủ cơ sở"]
OLD_REFUSALS = [
    "tôi không thể", "không thể chia sẻ", "không thể trả lời", "không hỗ trợ", "không được phép", "vi phạm",
    "nhạy cảm", "tiêu chuẩn cộng đồng", "chính sách", "không phù hợp", "tôi là ai",
]
OLD_NO_INFO = ["không có thông tin", "không được đề cập", "không tìm thấy", "không đủ cơ sở", "không có dữ liệu", "tất cả đều sai", "không có phương án"]
OLD_DIRTY = ["khiêu dâm", "ấu dâm", "sex", "porn", "xxx", "cá độ"]
OLD_BAD_INTENT = [
    r"(?:cách|phương pháp)[^\n]*(?:vi phạm|trốn|tránh|lách|làm giả)",
    r"tránh[^\n]*(?:cung cấp|khai báo)[^\n]*(?:thông tin|hồ sơ)",
    r"tiếp tục[^\n]*hoạt động[^\n]*(?:bị đình chỉ|bị cấm)",
]
OLD_BLACKLIST = [
    "sex", "khiêu dâm", "đồi trụy", "làm tình", "ấu dâm", "kích dục", "phản động", "khủng bố", "giết người", "ma túy",
    "buôn lậu", "vũ khí", "bạo lực", "xúc phạm", "lăng mạ", "đảng cộng sản", "xuyên tạc", "cờ bạc", "cá độ",
]
OLD_WHITELIST = [
    "luật", "nghị định", "quy định", "thông tư", "pháp luật", "hiến pháp", "lịch sử", "chiến tranh", "kháng chiến", "vụ án",
    "tòa án", "xét xử", "tác hại", "phòng chống", "ngăn chặn", "khái niệm", "định nghĩa",
]
LEGAL_HARD = ["luật", "nghị định", "thông tư", "hiến pháp", "quy định", "điều khoản", "phạt tù", "xử phạt"]
MATH_HARD = r"\$|\\frac|\\int|\\sum|\^\{|sin\(|cos\(|tan\("
