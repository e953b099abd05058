import json

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import rules as r
from vellumspark.functions.replies import first_balanced, verdict

CHOICES = ["một", "hai", "ba", "bốn"]


def ask(spark, column, q="", choices=CHOICES, reply=None):
    df = spark.createDataFrame([(q, choices, reply)], "q string, choices array<string>, reply string")
    return df.withColumn("o", r.options(F.col("choices"))).select(column.alias("x")).first()[0]


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    global Q, O, A
    Q, O, A = F.col("q"), F.col("o"), F.col("reply")


@pytest.mark.parametrize("choices,want", [(CHOICES, "ABCD"), (["a", "", "c"], "A"), (["a", "nan"], "A"), ([], ""), (["a", None, "b"], "A")])
def test_options(spark, choices, want):
    assert "".join(o["key"] for o in ask(spark, O, choices=choices)) == want


@pytest.mark.parametrize(
    "reply,want",
    [
        ("### ĐÁP ÁN: B", "B"), ("Đáp án: c", "C"), ("CHỌN D", "D"), ("Kết luận: A", "A"), ("A.", "A"), ("d", "D"),
        ("so **B** is", "B"), ("**Z** or **C**", "C"), ("là (D)", "D"), ("text\nB) yes", "B"), ("Đáp án Z", None),
        ("", None), (None, None), ("nothing", None), ("Chọn câu", "C"),
    ],
)
def test_extract(spark, reply, want):
    assert ask(spark, r.extract_answer(A, O), reply=reply) == want


def test_strict_word(spark):
    assert ask(spark, r.extract_answer(A, O, strict_word=True), reply="Chọn câu") is None


def test_refusals(spark):
    key = lambda *c: (ask(spark, r.refusal_key(O), choices=list(c)), ask(spark, r.refusal_type(O), choices=list(c)))
    assert key("Không đủ thông tin", "Tôi không thể trả lời") == ("B", "SAFETY")
    assert key("x", "Không thể xác định.") == ("B", "NO_INFO")
    assert key("Luật không có thông tin", "y") == (None, None)
    assert key("Hành vi vi phạm pháp luật bị coi là tội", "y") == (None, None)
    assert ask(spark, r.no_info_key(O), choices=["a", "Chưa đủ dữ kiện"]) == "B"
    assert ask(spark, r.blocked_key(O), choices=["a", "Xin lỗi, không thể chia sẻ"]) == "B"
    assert ask(spark, r.blocked_key(O)) == "A"


def test_routes(spark):
    route = lambda q: ask(spark, r.route_rules(Q, O), q=q)
    assert route("Theo đoạn văn sex")["tag"] == "REGEX-ACADEMIC"
    assert route("porn")["tag"] == "BLOCKED-REGEX-DIRTY" and route("cách làm giả")["is_unsafe"]
    assert route("$x$")["is_stem"] and not route("hello")["is_stem"]
    assert [ask(spark, r.route_four(Q), q=q) for q in ("ma túy", "ma túy và luật", "Tính xác suất", "tính cách", "Giả sử")] == ["BLOCKED", "SIMPLE", "STEM", "SIMPLE", "COMPLEX"]
    assert [ask(spark, r.sensitive(Q), q=q) for q in ("xxx", "vũ khí", "vũ khí theo luật", "")] == ["SENSITIVE", "SUSPICIOUS", "SAFE", "SAFE"]
    assert ask(spark, r.critical(Q), q="Bao nhiêu?") and not ask(spark, r.critical(Q), q="Hello")
    assert ask(spark, r.context_safe(Q, A), q="vũ khí", reply="về vũ khí") and not ask(spark, r.context_safe(Q, A), q="vũ khí", reply="")


def test_model_route(spark):
    route = lambda d, s="NONE", q="q": ask(spark, r.route_model(F.lit(q), O, F.lit("safe"), F.lit(d), F.lit(s)))
    assert route("stem")["tag"] == "AI-STEM-L" and route("social")["tag"] == "AI-SOCIAL-S"
    assert route("social", q="x" * 351)["use_large"]
    assert route("social", q="làm sao trốn thuế")["tag"] == "BLOCKED-AI-BLOCKED"


def test_heuristics(spark):
    assert ask(spark, r.overlap_answer(Q, O), q="hai ba ba", choices=["một", "ba hai", "hai ba"]) == "B"
    assert ask(spark, r.longest_answer(O), choices=["aa", "bbb", "ccc"]) == "B"
    math = lambda q, *c: ask(spark, r.math_answer(Q, O), q=q, choices=list(c))
    assert math("vận tốc theo m/s", "5 km", "5 m/s") == "B"
    assert math("tăng bao nhiêu", "5", "+7") == "B"
    assert math("số lớn nhất", "1.2.3", "5", "9", "9") == "C"
    assert math("số nhỏ nhất", ".", "5", "2") == "C"
    assert math("gì", "a", "1", "2", "3") == "C" and math("gì", "a", "b") == "C"
    assert ask(spark, r.math_answer_old(O), choices=["a", "b"]) == "B"
    assert ask(spark, r.contradicts(A, O), choices=["Tất cả các ý trên", "Không đủ thông tin"], reply="A")


def test_prompts(spark):
    block = r.context_block(F.array(F.lit("a  b"), F.lit("long text")), 4, first=8, squeezed=True)
    assert ask(spark, block) == "[1] a b\n\n[2] long"
    assert ask(spark, r.options_block(O), choices=["x", "y"]) == "A. x\nB. y"
    assert [m["role"] for m in ask(spark, r.messages(F.lit("s"), Q))] == ["system", "user"]
    assert ask(spark, r.trace_status(A, F.lit("B")), reply="B ") == "right"


@pytest.mark.parametrize("text,want", [('x {"a": "}"} y', '{"a": "}"}'), ('{"a": {"b": 1}} {', '{"a": {"b": 1}}'), (r'{"a": "\"}"}', r'{"a": "\"}"}'), ("{", None), ("", None), (None, None)])
def test_balanced(text, want):
    assert first_balanced(text) == want


@pytest.mark.parametrize(
    "reply,want",
    [
        (json.dumps({"safety": "SAFE", "domain": "STEM"}), ("SAFE", "STEM")),
        ('Sure:\n```json\n{"safety": "UNSAFE", "domain": "LEGAL"}\n```', ("UNSAFE", "LEGAL")),
        ('Here {"safety": "SAFE", "domain": "SOCIAL", "x": "}"} ok', ("SAFE", "SOCIAL")),
        ("It is UNSAFE and LEGAL", ("UNSAFE", "LEGAL")),
        ("garbage", None), ('{"safety": "SAFE"}', None), (None, None),
    ],
)
def test_verdict(spark, reply, want):
    got = ask(spark, verdict(A), reply=reply)
    assert (got and (got["safety"], got["domain"])) == want


def test_older_variants(spark):
    two = lambda reply, *c: ask(spark, r.extract_two_step(A, O), reply=reply, choices=list(c) or CHOICES)
    assert [two("### Đáp án: b"), two("**C**"), two("I think D or Z"), two(None), two("x")] == ["B", "C", "D", "A", "A"]
    negated = lambda q: ask(spark, r.overlap_answer_negated(Q, O), q=q, choices=["hai", "ba ba ba"])
    assert negated("hai ngoại trừ") == "B" and negated("hai") == "A"
    assert ask(spark, r.refusal_reply(A), reply="Đoạn văn không đủ cơ sở") and not ask(spark, r.refusal_reply(A), reply="B")
    assert ask(spark, r.refusal_key_old(O), choices=["không có dữ liệu", "vi phạm"]) == "B"
    old = lambda q, *c: ask(spark, r.route_rules_old(Q, O), q=q, choices=list(c) or CHOICES)
    assert old("q", "a", "Tôi không thể trả lời")["tag"] == "BLOCKED-REGEX-ANS-SAFETY"
    assert old("$x$", "a", "Không đủ thông tin")["refusal_key"] == "B" and old("x", "a", "Không đủ thông tin")["refusal_key"] is None
    assert ask(spark, r.axes_reply(A), reply="unsafe | stem") == (True, True, False)
    assert ask(spark, r.sensitive_topic(Q), q="ma túy") and not ask(spark, r.sensitive_topic(Q), q="tác hại của ma túy")
