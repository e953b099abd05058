"""More queries: rules, answers, prompts and text functions, each with its SQL. In brackets: rows of SURVEY section 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts, replies
from ..functions import rules as r
from ..functions import text as t
from ..functions import words as w
from ..operators import retrieval
from ..providers import growing_wait, linear_wait
from .catalog import S_BM25, S_NO_INFO, S_OPTIONS, S_PHRASED, S_REFUSAL, S_SAFETY, bm25, option_questions, phrased, query, refusal_questions, s_any, s_key, s_lit, s_match, tbl

# --- text


@query(r"""SELECT doc_id, sha256(array_to_string(list_transform(string_split(translate(nfc_normalize(x), chr(160) || chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(13), ' '), chr(10)), lambda l: trim(l)), chr(10))) AS clean
FROM (SELECT doc_id, replace(text, 'é', 'e' || chr(769)) || chr(160) || chr(8203) || chr(13) || chr(10) || ' end ' AS x FROM documents)""")
def space_clean(spark, d):
    """Composed characters and plain spaces [I7]: the texts with decomposed letters and special spaces put in."""
    x = F.concat(F.replace("text", F.lit("é"), F.lit("é")), F.lit(" ​\r\n end "))
    return tbl(spark, d, "documents").select("doc_id", F.sha2(t.clean_spaces(t.nfc(x)), 256).alias("clean"))


S_MARKED = "replace(replace(text, '. ', '. Điều 5. '), ', ', ', MỤC II ')"


@query(rf"SELECT doc_id, sha256(regexp_replace({S_MARKED}, '([^\n])(Điều \d+|CHƯƠNG|MỤC|PHẦN)', '\1' || chr(10) || '\2', 'g')) AS broken FROM documents")
def marker_breaks(spark, d):
    """Lines broken before article and chapter markers [I8]: the texts with markers put in."""
    x = F.replace(F.replace("text", F.lit(". "), F.lit(". Điều 5. ")), F.lit(", "), F.lit(", MỤC II "))
    return tbl(spark, d, "documents").select("doc_id", F.sha2(t.break_before_markers(x), 256).alias("broken"))


S_LONE_TWICE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\n([^\n])', '. \1'), '([^\n])\n$', '\1. '), '([^\n])\n([^\n])', '\1. \2', 'g'), '([^\n])\n([^\n])', '\1. \2', 'g')"


@query(f"SELECT doc_id, sha256(CASE WHEN text = chr(10) THEN '. ' ELSE {S_LONE_TWICE} END) AS joined FROM documents")
def lone_newlines(spark, d):
    """Lone line feeds to full stops [I4]."""
    return tbl(spark, d, "documents").select("doc_id", F.sha2(t.join_lone_newlines(F.col("text")), 256).alias("joined"))


@query("""SELECT page_id, array_to_string(list_transform(list_filter(string_split(translate(slug, '-_', '  '), ' '), lambda x: true), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ') AS title
FROM (SELECT page_id, list_extract(string_split(regexp_replace(split_part(url, '?', 1) || '/some-page_name-' || page_id || '/', '/+$', ''), '/'), -1) AS slug FROM pages)""")
def slug_titles(spark, d):
    """Names from the last part of a URL [I24]."""
    url = F.concat(F.element_at(F.split("url", "[?]"), 1), F.lit("/some-page_name-"), F.col("page_id").cast("string"), F.lit("/"))
    return tbl(spark, d, "pages").select("page_id", t.slug_title(url).alias("title"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%d/%m/%Y') AS day FROM events")
def event_dates(spark, d):
    """Timestamps as text [I25]."""
    return tbl(spark, d, "events").select("event_id", t.iso_time(F.col("ts")).alias("iso"), t.day_month_year(F.col("ts")).alias("day"))


@query("SELECT conv_id, turn, round(power(1.5, turn), 6) AS growing, CAST(3 * (turn + 1) + 0.5 AS DOUBLE) AS linear FROM conversations")
def retry_waits(spark, d):
    """Seconds before another try, by its number: the providers' own functions over the turns there are [I29, S7]."""
    turns = tbl(spark, d, "conversations").select("turn").distinct().limit(10_001).collect()
    if len(turns) > 10_000:
        raise ValueError("over 10,000 different turns")
    waits = spark.createDataFrame([(x["turn"], round(growing_wait(x["turn"]), 6), linear_wait(x["turn"], 0.5)) for x in turns], "turn long, growing double, linear double")
    return tbl(spark, d, "conversations").select("conv_id", "turn").join(F.broadcast(waits), "turn").select("conv_id", "turn", "growing", "linear")


@query("SELECT conv_id, turn, TRY_CAST(regexp_extract(x, '([0-9.]+)', 1) AS DOUBLE) AS number, regexp_matches(x, '[0-9]') AS has_digit FROM (SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN text WHEN 1 THEN text || ' ' || (length(text) * 3) || '.5 kg' ELSE replace(text, '.', ' ') || ' ' || length(text) || ' m' END AS x FROM conversations)")
def first_numbers(spark, d):
    """The first number of a whole text [I26]: by turns the text itself, where a full stop alone is no number, with a number after it, and with one but without full stops."""
    text, n = F.col("text"), F.length("text")
    shapes = [text, F.concat(text, F.lit(" "), (n * 3).cast("string"), F.lit(".5 kg")), F.concat(F.replace(text, F.lit("."), F.lit(" ")), F.lit(" "), n.cast("string"), F.lit(" m"))]
    rows = tbl(spark, d, "conversations").withColumn("x", F.get(F.array(*shapes), ((F.col("conv_id") + F.col("turn")) % 3).cast("int")))
    return rows.select("conv_id", "turn", r.first_number(F.col("x")).alias("number"), F.col("x").rlike(r"\d").alias("has_digit"))


# --- JSON replies

JSON_SHAPES = [
    '{t} {"a": "}{", "b": {"c": "\\"}"}} {t}',
    '{t}',
    '```json\n{"safety": "{s}", "domain": "{d}", "refusal_status": "NONE"}\n```',
    '{"safety": "{s}", "domain": "{d}", "refusal_status": "TRAP_IGNORED"}',
    'I say {"safety": "{s}", "domain": "{d}", "why": "a } brace"} so.',
    '{t} {s} and {d}',
    '{"safety": "{s}"}',
    '{"unclosed": {"safety": "{s}"',
]
S_JSON = f"""j AS (SELECT conv_id, turn, (conv_id + turn) % {len(JSON_SHAPES)} AS k, CASE WHEN length(text) % 2 = 0 THEN 'SAFE' ELSE 'UNSAFE' END AS s, list_extract(['STEM', 'LEGAL', 'SOCIAL'], CAST(length(text) % 3 AS INT) + 1) AS dom, text FROM conversations),
x AS (SELECT *, replace(replace(replace(list_extract([{', '.join(map(s_lit, JSON_SHAPES))}], CAST(k AS INT) + 1), '{{s}}', s), '{{d}}', dom), '{{t}}', text) AS reply FROM j)"""


def json_replies(spark, d):
    shape = F.element_at(F.array(*[F.lit(x) for x in JSON_SHAPES]), ((F.col("conv_id") + F.col("turn")) % len(JSON_SHAPES) + 1).cast("int"))
    safety, domain = F.when(F.length("text") % 2 == 0, "SAFE").otherwise("UNSAFE"), F.element_at(F.array(*map(F.lit, ["STEM", "LEGAL", "SOCIAL"])), (F.length("text") % 3 + 1).cast("int"))
    reply = F.replace(F.replace(F.replace(shape, F.lit("{s}"), safety), F.lit("{d}"), domain), F.lit("{t}"), F.col("text"))
    return tbl(spark, d, "conversations").select("conv_id", "turn", reply.alias("reply"))


@query(f"""WITH {S_JSON} SELECT conv_id, turn, CASE k WHEN 0 THEN '{{"a": "}}{{", "b": {{"c": "\\"}}"}}}}' WHEN 1 THEN NULL WHEN 5 THEN NULL WHEN 7 THEN NULL
WHEN 4 THEN '{{"safety": "' || s || '", "domain": "' || dom || '", "why": "a }} brace"}}' ELSE regexp_extract(reply, '\\{{[^{{}}]*\\}}', 0) END AS json FROM x""")
def balanced_braces(spark, d):
    """The first balanced braces of a reply [I21]; the texts themselves have none."""
    return json_replies(spark, d).select("conv_id", "turn", replies.balanced_json("reply").alias("json"))


@query(f"""WITH {S_JSON} SELECT conv_id, turn, CASE WHEN k IN (2, 3, 4, 5) THEN s END AS safety, CASE WHEN k IN (2, 3, 4, 5) THEN dom END AS domain,
CASE k WHEN 2 THEN 'NONE' WHEN 3 THEN 'TRAP_IGNORED' WHEN 5 THEN 'NONE' END AS status FROM x""")
def verdicts(spark, d):
    """Verdicts from replies in any form [I22]."""
    told = replies.verdict(F.col("reply"))
    return json_replies(spark, d).select("conv_id", "turn", told.alias("v")).select("conv_id", "turn", "v.safety", "v.domain", F.col("v.refusal_status").alias("status"))


# --- rules

S_Q = f"q AS (SELECT *, lower(q) AS l FROM ({S_PHRASED}))"


@query(f"WITH {S_Q} SELECT conv_id, turn, {s_any('l', w.ACADEMIC)} AS academic, {s_any('l', w.SILENCE_SUSPICIOUS)} AND NOT {s_any('l', w.ACADEMIC)} AS silent_block FROM q")
def question_flags(spark, d):
    """Academic context, and whether an empty reply blocks [Q3, Q5]."""
    return phrased(spark, d).select("conv_id", "turn", r.academic(F.col("q")).alias("academic"), r.silent_block(F.col("q")).alias("silent_block"))


@query(f"WITH {S_Q} SELECT conv_id, turn, {s_any('l', w.RESCUE)} AND NOT {s_any('l', w.NO_RESCUE)} AS rescued FROM (SELECT conv_id, turn, l || CASE WHEN turn % 3 = 0 THEN ' lịch sử' ELSE '' END AS l FROM q)")
def rescued_questions(spark, d):
    """Historical questions that the older router rescues [Q11]."""
    asked = F.concat("q", F.when(F.col("turn") % 3 == 0, " Lịch sử").otherwise(""))
    return phrased(spark, d).select("conv_id", "turn", r.political_rescue(asked).alias("rescued"))


S_TOLD = """SELECT conv_id, turn, q, lower(q) AS l, list_extract(['SAFE', 'UNSAFE', NULL], CAST((conv_id + turn) % 3 AS INT) + 1) AS safety, list_extract(['STEM', 'LEGAL', 'SOCIAL', 'STEM'], CAST(length(q) % 4 AS INT) + 1) AS dom"""
CHOICES = ["một", "Tôi không thể trả lời", "Không đủ thông tin để kết luận", "bốn"]


def told_questions(spark, d):
    safety = F.element_at(F.array(F.lit("safe"), F.lit("UNSAFE"), F.lit(None)), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int"))
    domain = F.element_at(F.array(*map(F.lit, ["STEM", "LEGAL", "SOCIAL", "stem"])), (F.length("q") % 4 + 1).cast("int"))
    return phrased(spark, d).select("conv_id", "turn", "q", safety.alias("safety"), domain.alias("domain"), r.options(F.array(*map(F.lit, CHOICES))).alias("opts"))


@query(f"""WITH t AS ({S_TOLD} FROM ({S_PHRASED})) SELECT conv_id, turn, unsafe AS is_unsafe, NOT unsafe AND dom = 'STEM' AS is_stem, NOT unsafe AS use_large, CASE WHEN unsafe THEN 'BLOCKED-AI-BLOCKED' ELSE 'AI-' || dom || '-L' END AS tag,
CASE WHEN unsafe OR status = 'NO_INFO_VALID' THEN 'B' END AS refusal_key, CASE WHEN unsafe THEN 'SAFETY' WHEN status = 'NO_INFO_VALID' THEN 'NO_INFO' ELSE 'TRAP' END AS refusal_type
FROM (SELECT *, coalesce(safety, 'SAFE') = 'UNSAFE' OR {s_match('l', w.INTENT_OVERRIDE)} AS unsafe, CASE WHEN turn % 2 = 0 THEN 'NO_INFO_VALID' ELSE 'NONE' END AS status FROM t)""")
def routes_by_model(spark, d):
    """The model's verdict to a route, with the intent override and the blocked result [Q4, Q7]; one option is a refusal, so all are large."""
    status = F.when(F.col("turn") % 2 == 0, "NO_INFO_VALID").otherwise("NONE")
    return told_questions(spark, d).select("conv_id", "turn", r.route_model(F.col("q"), F.col("opts"), F.col("safety"), F.col("domain"), status).alias("x")).select("conv_id", "turn", "x.*")


@query(f"""WITH t AS ({S_TOLD} FROM ({S_PHRASED})) SELECT conv_id, turn, CASE WHEN safety IS NULL THEN CASE WHEN {s_any('l', w.OLD_DIRTY)} THEN 'BLOCKED-REGEX-DIRTY' WHEN {s_match('l', w.OLD_BAD_INTENT)} THEN 'BLOCKED-REGEX-INTENT' ELSE 'BLOCKED-REGEX-ANS-SAFETY' END
WHEN safety = 'UNSAFE' AND NOT ({s_any('l', w.RESCUE)} AND NOT {s_any('l', w.NO_RESCUE)}) OR {s_match('l', w.INTENT_OVERRIDE_OLD)} THEN 'BLOCKED-AI-BLOCKED'
ELSE 'AI-' || dom || CASE WHEN dom IN ('STEM', 'LEGAL') OR length(q) > 500 THEN '-L' ELSE '-S' END END AS tag FROM t""")
def routes_by_model_old(spark, d):
    """The older model router [Q11]."""
    return told_questions(spark, d).select("conv_id", "turn", r.route_model_old(F.col("q"), F.col("opts"), F.col("safety"), F.col("domain"))["tag"].alias("tag"))


@query("SELECT conv_id, turn, (conv_id + turn) % 4 = 1 AS unsafe FROM conversations")
def safety_confirmed(spark, d):
    """What the safety filter's replies say [Q16]; they hold the text, as a talkative filter's would."""
    said = F.element_at(F.array(F.lit(""), F.lit("unsafe."), F.lit("It is safe"), F.lit(None)), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    return tbl(spark, d, "conversations").select("conv_id", "turn", r.confirmed_unsafe(F.concat(said, F.lit(" "), "text")).alias("unsafe"))


@query(f"""SELECT conv_id, turn, contains(u, 'UNSAFE') AS is_unsafe, contains(u, 'STEM') AS is_stem, contains(u, 'COMPLEX') OR u = '' AS is_complex FROM (
SELECT conv_id, turn, upper(list_extract(['', 'safe stem', 'UNSAFE ' || text, 'Social, complex'], CAST((conv_id + turn) % 4 AS INT) + 1)) AS u FROM conversations)""")
def axes_replies(spark, d):
    """Three-axis text replies [Q12]."""
    said = F.element_at(F.array(F.lit(""), F.lit("safe stem"), F.concat(F.lit("UNSAFE "), "text"), F.lit("Social, complex")), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    return tbl(spark, d, "conversations").select("conv_id", "turn", r.axes_reply(said).alias("x")).select("conv_id", "turn", "x.*")


@query(f"WITH {S_OPTIONS}, {S_REFUSAL} SELECT qid, CASE WHEN {s_key(S_SAFETY)} IS NOT NULL THEN 'BLOCKED-ANSWER' WHEN {s_key(S_NO_INFO)} IS NOT NULL THEN 'NO_INFO_HINT' ELSE 'OPEN' END AS state, coalesce({s_key(S_SAFETY)}, {s_key(S_NO_INFO)}, {s_key(s_any('trim(lower(o))', w.BLOCK_PHRASES))}, 'A') AS blocked FROM r")
def answer_aware(spark, d):
    """Blocks and hints by the options alone, and the answer of a blocked question [Q18, Q7]."""
    return refusal_questions(spark, d).select("qid", r.answer_aware_block(F.col("options")).alias("state"), r.blocked_key(F.col("options")).alias("blocked"))


@query(f"WITH {S_Q} SELECT conv_id, turn, {' AND '.join(f'NOT (contains(l, {s_lit(x)}) AND NOT contains(c, {s_lit(x)}))' for x in w.SOFT_BAN + w.HARD_BAN)} AS safe FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN 'về vũ khí và giết' ELSE l END AS c FROM q)")
def context_safety(spark, d):
    """Suspicious words that the retrieved text has too are safe [Q19]."""
    context = F.when(F.col("turn") % 2 == 0, "Về vũ khí và giết").otherwise(F.col("q"))
    return phrased(spark, d).select("conv_id", "turn", r.context_safe(F.col("q"), context).alias("safe"))


# --- answers and prompts


@query(f"WITH {S_OPTIONS} SELECT qid, CASE WHEN qid % 3 = 2 THEN 'A' WHEN qid % 3 = 1 THEN 'B' ELSE 'C' END AS answer FROM q")
def math_answer_old(spark, d):
    """C, else B, else a numeric option [P16], over four, two and one options."""
    some = F.slice("choices", 1, F.element_at(F.array(F.lit(4), F.lit(2), F.lit(1)), (F.col("qid") % 3 + 1).cast("int")))
    return option_questions(spark, d).select("qid", r.math_answer_old(r.options(some)).alias("answer"))


S_ALL = f"({s_match('lower(o)', w.ALL_ABOVE)})"


@query(f"""WITH {S_OPTIONS}, {S_REFUSAL}, k AS (SELECT *, coalesce({s_key(S_SAFETY)}, {s_key(S_NO_INFO)}) AS rk, chr(65 + CAST(qid % 4 AS INT)) AS a FROM r)
SELECT qid, coalesce(list_extract(list_transform(opts, lambda o: {S_ALL}), CAST(qid % 4 AS INT) + 1) AND rk <> a, false) AS contradicts FROM k""")
def contradictions(spark, d):
    """Answers that say 'all of them' beside a refusal [P12]."""
    answer = F.chr(65 + F.col("qid") % 4)
    return refusal_questions(spark, d).select("qid", r.contradicts(answer, F.col("options")).alias("contradicts"))


@query(f"""WITH {S_OPTIONS}, {S_REFUSAL}, k AS (SELECT *, coalesce({s_key(S_SAFETY)}, {s_key(S_NO_INFO)}) AS rk, CASE WHEN {s_key(S_SAFETY)} IS NULL THEN {s_key(S_NO_INFO)} END AS hint, CASE WHEN qid % 5 > 0 THEN chr(65 + CAST(qid % 4 AS INT)) END AS a, CASE WHEN qid % 2 = 0 THEN 'không có thông tin' ELSE question END AS reply FROM r JOIN (SELECT qid, question FROM q) USING (qid)),
c AS (SELECT *, coalesce(CASE WHEN a IS NULL OR (contains(lower(reply), 'không') AND contains(lower(reply), 'thông tin')) THEN hint END, a) AS last FROM k)
SELECT qid, CASE WHEN NOT coalesce(list_extract(list_transform(opts, lambda o: {S_ALL}), ascii(last) - 64) AND rk <> last, false) THEN last END AS answer FROM c""")
def hint_checks(spark, d):
    """The letter after the hint and contradiction checks [P11, P12]."""
    rows = refusal_questions(spark, d).withColumn("answer", F.when(F.col("qid") % 5 > 0, F.chr(65 + F.col("qid") % 4))).withColumn("reply", F.when(F.col("qid") % 2 == 0, "Không có thông tin").otherwise(F.col("question")))
    checked = r.checked_answer(F.col("reply"), F.col("answer"), F.col("options"), r.refusal_key(F.col("options")), r.refusal_type(F.col("options")), use_hint=True)
    return rows.select("qid", checked.alias("answer"))


@query(f"SELECT conv_id, turn, {s_any('lower(x)', w.REFUSAL_REPLIES)} AS refused FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN text || ' Không đủ cơ sở' ELSE text END AS x FROM conversations)")
def refused_replies(spark, d):
    """Replies that say they do not know [P8]."""
    x = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat("text", F.lit(" Không đủ cơ sở"))).otherwise(F.col("text"))
    return tbl(spark, d, "conversations").select("conv_id", "turn", r.refusal_reply(x).alias("refused"))


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = doc_id % 2 THEN 'right' ELSE 'wrong' END AS status,
'[' || doc_id || '] ' || upper(CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = doc_id % 2 THEN 'right' ELSE 'wrong' END) || ' answer=' || doc_id % 2 || ' truth=' || coalesce(CAST(quality AS VARCHAR), '-') AS line FROM documents LEFT JOIN labels USING (doc_id)""")
def trace_lines(spark, d):
    """The trace table with a readable line for each answer [B15, P21]."""
    joined = tbl(spark, d, "documents").select("doc_id").join(tbl(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("truth")), "doc_id", "left")
    answer = F.concat(F.lit(" "), (F.col("doc_id") % 2).cast("string"))
    return joined.select("doc_id", r.trace_status(answer, F.col("truth")).alias("status"), r.trace_line(F.col("doc_id"), answer, F.col("truth")).alias("line"))


@query("""SELECT CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = doc_id % 2 THEN 'right' ELSE 'wrong' END AS status, lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def trace_counters(spark, d):
    """Running counters as counts over the trace [E3]."""
    joined = tbl(spark, d, "documents").select("doc_id", "lang").join(tbl(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("truth")), "doc_id", "left")
    return joined.groupBy(r.trace_status((F.col("doc_id") % 2).cast("string"), F.col("truth")).alias("status"), "lang").agg(F.count(F.lit(1)).alias("n"))


S_BODY = "trim(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
S_LISTED = "SELECT qid, list(text ORDER BY rank) AS ts, list(source ORDER BY rank) AS titles FROM sr JOIN documents ON doc_id = chunk_id WHERE rank <= 8 GROUP BY qid"
S_TAIL = "chr(10) || chr(10) || 'Question: ' || q || chr(10) || 'A. yes' || chr(10) || 'B. no'"


def s_prompt(context: str) -> str:
    return f"sha256('Passages:' || chr(10) || {context} || {S_TAIL})"


def s_blocks(body: str, ts: str = "ts") -> str:
    return f"array_to_string(list_transform({ts}, lambda t, i: '[' || i || '] ' || {body}), chr(10) || chr(10))"


@query(f"""WITH {S_BM25}, c AS (SELECT *, 'What is ' || qid || '?' AS q FROM ({S_LISTED})) SELECT qid, {s_prompt(s_blocks('substring(t, 1, 3500)'))} AS reasoning, {s_prompt(s_blocks(f'substring({S_BODY}, 1, 2000)', 'list_slice(ts, 1, 8)'))} AS simple,
sha256({s_lit(prompts.TIERS + ' ')} || CASE WHEN qid % 2 = 0 THEN {s_lit(prompts.TAILS['stem'])} ELSE {s_lit(prompts.TAILS['social'])} END || {s_lit(' ' + prompts.ENDING)}) AS instruction,
{s_prompt(s_blocks('t'))} AS whole, {s_prompt(s_blocks("array_to_string(list_slice(string_split(" + S_BODY + ", ' '), 1, 350), ' ') || '...'"))} AS words, {s_prompt(s_blocks('substring(t, 1, 500)'))} AS short,
{s_prompt("array_to_string(list_transform(ts, lambda t, i: '[' || i || '] (' || coalesce(titles[i], 'Unknown') || ')' || chr(10) || t), chr(10) || chr(10))")} AS titled FROM c""")
def prompt_texts(spark, d):
    """All prompts over the eight best documents of each question [P1, P2, P3, P4, I6, I30]."""
    found = retrieval.with_payload(bm25(spark, d, 8), retrieval.spread(tbl(spark, d, "documents")), "doc_id", ["text", "source"], 8 * tbl(spark, d, "benchmark").count())
    rows = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "source"))).alias("h"))  # eight a question
    texts, titles = F.transform("h", lambda x: x["text"]), F.transform("h", lambda x: x["source"])
    question, opts = F.concat(F.lit("What is "), F.col("qid").cast("string"), F.lit("?")), r.options(F.array(F.lit("yes"), F.lit("no")))
    made = {"reasoning": prompts.reasoning(question, opts, texts), "simple": prompts.simple(question, opts, texts), "instruction": prompts.instruction(F.col("qid") % 2 == 0)} | prompts.older(question, opts, texts, titles)
    return rows.select("qid", *[F.sha2(c, 256).alias(k) for k, c in made.items()])
