"""The jobs as queries over the driver's tables, each run twice into one new folder, and the SQL that their output equals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import words as w
from vellumspark.plans import catalog as c
from vellumspark.storage import checkpoint_dir

from . import answer_sheet, passage_feed


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it stays."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_passage_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage table after two runs over all document files."""
    folder = _folder(spark, "passage-feed")
    for _ in range(2):
        out = passage_feed.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/table", f"{folder}/state")
    return out


S_FOOTER = f"list_position(list_transform(lines, lambda l: length(trim(l)) < 50 AND (starts_with(trim(l), '=') OR starts_with(trim(l), '#') OR l = upper(l)) AND list_contains([{', '.join(map(c.s_lit, w.FOOTER_STEM))}], trim(lower(trim(l)), '=#-:. '))), true)"
PASSAGE_SQL = f"""
WITH x AS (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL),
m AS (SELECT *, {S_FOOTER} AS pos FROM x),
b AS (SELECT doc_id, lang, source, string_split(array_to_string(CASE WHEN pos > 0 THEN list_slice(lines, 1, pos - 1) ELSE lines END, chr(10)), chr(10) || chr(10)) AS ls FROM m),
p AS (SELECT doc_id, lang, source, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS part, unnest(ls) AS l FROM b),
k AS (SELECT *, 'doc_' || doc_id || '_' || part AS name, trim(regexp_replace(regexp_replace(l, '{w.CITATION_DIGITS}', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t, lower(concat_ws(' > ', lang, source)) AS category
      FROM p WHERE length(l) >= 50 OR {c.s_flag('has_formula', 'l')} OR {c.s_flag('has_table', 'l')} OR {c.s_flag('has_legal', 'l')}),
h AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(name)) AS h FROM k WHERE t <> '')
SELECT doc_id, part, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS passage_id,
       lang, CASE WHEN {c.s_any('category', w.STEM_DOMAIN)} THEN 'stem' WHEN {c.s_any('category', w.LEGAL_DOMAIN)} THEN 'legal' ELSE 'general' END AS domain,
       t AS text, CAST(length(t) AS INT) AS n_chars, {', '.join(f"{c.s_flag(f, 'l')} AS {f}" for f in passage_feed.FLAGS)}
FROM h"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with choices made of the benchmark's items: a phrase that some rule knows before the text, some options that refuse."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in c.PHRASES]), (F.col("qid") % len(c.PHRASES) + 1).cast("int"))
    return c.refusal_questions(spark, sf_dir).select(F.col("qid").cast("string").alias("qid"), F.concat(phrase, F.lit(" "), "question").alias("question"), "choices")


def job2_answer_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer sheet of all items after two runs."""
    folder = _folder(spark, "answer-sheet")
    asked(spark, sf_dir).write.parquet(f"{folder}/questions")
    for _ in range(2):
        out = answer_sheet.run(spark, f"{folder}/questions", f"{sf_dir}/documents.parquet", f"{folder}/sheet")
    return out


S_BLOCKED = f"coalesce({c.s_key(c.S_SAFETY)}, {c.s_key(c.S_NO_INFO)}, {c.s_key(c.s_any('trim(lower(o))', w.BLOCK_PHRASES))}, 'A')"
S_NUMERIC = f"""coalesce(CASE WHEN unit IS NOT NULL THEN {c.s_key("contains(lower(o), unit)")} END,
 CASE WHEN {c.s_any('low', w.CHANGE_WORDS)} THEN {c.s_key(c.s_any('lower(o)', ['%', '+', 'tăng']))} END,
 CASE WHEN {c.s_any('low', w.MOST_WORDS)} THEN {c.s_argmax(c.S_NUMBER)} END,
 CASE WHEN {c.s_any('low', w.LEAST_WORDS)} THEN {c.s_argmax('-' + c.S_NUMBER)} END,
 list_filter(['A', 'B', 'C', 'D'], lambda k: regexp_matches(opts[ascii(k) - 64], '[0-9]'))[len(list_filter(['A', 'B', 'C', 'D'], lambda k: regexp_matches(opts[ascii(k) - 64], '[0-9]'))) // 2 + 1], 'C')"""
S_EVIDENCE = c.s_argmax(f"len(list_intersect({c.s_tokens('o')}, {c.s_tokens('known')}))")
SHEET_SQL = f"""
WITH {c.S_OPTIONS}, {c.S_REFUSAL},
a AS (SELECT r.qid, ([{', '.join(map(c.s_lit, c.PHRASES))}])[r.qid % {len(c.PHRASES)} + 1] || ' ' || q.question AS question, r.opts FROM r JOIN q USING (qid)),
l AS (SELECT *, lower(question) AS low FROM a),
t AS (SELECT *, CASE WHEN {c.s_any('low', w.ACADEMIC)} THEN 'REGEX-ACADEMIC' WHEN {c.s_any('low', w.DIRTY)} THEN 'BLOCKED-REGEX-DIRTY' WHEN {c.s_match('low', [w.BAD_INTENT])} THEN 'BLOCKED-REGEX-INTENT' ELSE 'REGEX-FALLBACK' END AS tag FROM l),
o AS (SELECT *, starts_with(tag, 'BLOCKED') AS blocked, tag = 'REGEX-FALLBACK' AND {c.s_match('low', [w.MATH_HINT])} AS stem,
      nullif(regexp_extract(low, '(?:^|[^\\p{{L}}\\p{{N}}_])({w.UNITS})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '') AS unit FROM t),
{c.S_BM25.replace(f"SELECT item_id AS qid, unnest({c.s_tokens('text')}) AS term FROM benchmark", f"SELECT qid, unnest({c.s_tokens('question')}) AS term FROM o WHERE NOT blocked")},
e AS (SELECT qid, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS evidence, string_agg(substring(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 2000), ' ' ORDER BY rank) AS texts
      FROM sr JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY qid),
z AS (SELECT o.*, concat_ws(' ', question, texts) AS known, coalesce(evidence, '') AS evidence FROM o LEFT JOIN e USING (qid))
SELECT CAST(qid AS VARCHAR) AS qid, CASE WHEN blocked THEN {S_BLOCKED} WHEN stem THEN {S_NUMERIC} ELSE {S_EVIDENCE} END AS answer,
       CASE WHEN blocked THEN 'blocked' WHEN stem THEN 'numeric' ELSE 'evidence' END AS status, evidence, tag
FROM z"""

QUERIES = {"job1_passage_feed": job1_passage_feed, "job2_answer_sheet": job2_answer_sheet}
ORACLES = {"job1_passage_feed": PASSAGE_SQL, "job2_answer_sheet": SHEET_SQL}
