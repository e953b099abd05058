"""The answering pipeline with scripted models, and the SQL that its answers equal. In brackets: rows of SURVEY section 2."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions import words as w
from ..operators import chunking
from ..providers import HashedEmbedder, embed
from ..schemas import from_documents
from ..storage import stored
from .answering import FORCE_PROMPT, answer, answered_from
from .catalog import ASKS, S_NO_INFO, S_NO_INFO_WIDE, S_NUMBER, S_OPTIONS, S_REFUSAL, S_SAFETY, query, refusal_questions, s_any, s_argmax, s_key, s_lit, s_match, s_tokens, tbl

VERDICTS = [("UNSAFE", "SOCIAL", "NONE"), ("SAFE", "STEM", "NONE"), ("SAFE", "LEGAL", "NONE"), ("SAFE", "SOCIAL", "NONE"), ("SAFE", "SOCIAL", "NO_INFO_VALID")]


def _number(user: str) -> int:
    """The question's number, which stands in its text between two marks."""
    return int(re.search(r"qq(\d+)qq", user)[1])


class Router:
    """By turns each verdict, and a reply that none can be read from."""

    def reply(self, system: str, user: str) -> str:
        turn = _number(user) % (len(VERDICTS) + 1)
        return json.dumps(dict(zip(("safety", "domain", "refusal_status"), VERDICTS[turn], strict=True))) if turn < len(VERDICTS) else "no verdict"


class Large:
    """Silent for numbers that 5 divides, without knowledge for those of 7, unsure for those of 11, else B; D where it has to know."""

    def reply(self, system: str, user: str) -> str:
        n = _number(user)
        if system == FORCE_PROMPT:
            return "### ĐÁP ÁN: D"
        return "" if n % 5 == 0 else "không có thông tin" if n % 7 == 0 else "không rõ thông tin" if n % 11 == 0 else "### ĐÁP ÁN: B"


class Small:
    """Silent for numbers that 4 divides, else C."""

    def reply(self, system: str, user: str) -> str:
        return "" if _number(user) % 4 == 0 else "### ĐÁP ÁN: C"


S_HEURISTIC = f"""CASE WHEN stem THEN coalesce(CASE WHEN unit IS NOT NULL THEN {s_key("contains(lower(o), unit)")} END,
 CASE WHEN {s_any('low', w.CHANGE_WORDS)} THEN {s_key(s_any('lower(o)', ['%', '+', 'tăng']))} END,
 CASE WHEN {s_any('low', w.MOST_WORDS)} THEN {s_argmax(S_NUMBER)} END,
 CASE WHEN {s_any('low', w.LEAST_WORDS)} THEN {s_argmax('-' + S_NUMBER)} END, numeric[len(numeric) // 2 + 1], 'C')
 ELSE {s_argmax(f'len(list_intersect({s_tokens("o")}, {s_tokens("question")}))')} END"""
S_ANSWERS = f"""
WITH {S_OPTIONS}, {S_REFUSAL},
a AS (SELECT r.qid, r.opts, ([{', '.join(map(s_lit, ASKS))}])[r.qid % {len(ASKS)} + 1] || q.question || ' qq' || r.qid || 'qq' AS question, r.qid % 6 AS turn FROM r JOIN q USING (qid)),
k AS (SELECT *, lower(question) AS low, {s_key(S_SAFETY)} AS safety, {s_key(S_NO_INFO)} AS no_info, {s_key(S_NO_INFO_WIDE)} AS wide, {s_key(s_any('trim(lower(o))', w.BLOCK_PHRASES))} AS block FROM a),
t AS (SELECT *, coalesce(safety, no_info) AS refusal, turn = 0 OR (turn < 5 AND {s_match('low', w.INTENT_OVERRIDE)}) AS unsafe,
      turn = 1 OR (turn = 5 AND {s_match('low', [w.MATH_HINT])}) AS stem, turn IN (1, 2, 4, 5) OR length(question) > 350 OR coalesce(safety, no_info) IS NOT NULL AS large,
      list_filter(['A', 'B', 'C', 'D'], lambda x: regexp_matches(opts[ascii(x) - 64], '[0-9]')) AS numeric,
      nullif(regexp_extract(low, '(?:^|[^\\p{{L}}\\p{{N}}_])({w.UNITS})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '') AS unit FROM k),
m AS (SELECT *, CASE WHEN qid % 5 = 0 THEN '' WHEN qid % 7 = 0 THEN 'unknown' WHEN qid % 11 = 0 THEN 'unsure' ELSE 'B' END AS says_large, CASE WHEN qid % 4 = 0 THEN '' ELSE 'C' END AS says_small FROM t),
f AS (SELECT *, CASE WHEN large THEN coalesce(nullif(says_large, ''), says_small) ELSE coalesce(nullif(says_small, ''), says_large) END AS first FROM m),
g AS (SELECT *, CASE WHEN first = 'unknown' THEN coalesce(wide, CASE WHEN large THEN 'D' WHEN says_small <> '' THEN 'C' ELSE 'D' END) ELSE first END AS said FROM f),
h AS (SELECT *, CASE WHEN said = 'unsure' AND turn = 4 AND refusal IS NOT NULL THEN refusal WHEN said IN ('', 'unsure') THEN NULL ELSE said END AS letter FROM g),
z AS (SELECT *, CASE WHEN letter IS NOT NULL AND NOT ({s_match("lower(opts[ascii(letter) - 64])", w.ALL_ABOVE)} AND refusal IS NOT NULL AND refusal <> letter) THEN letter END AS sound FROM h)
SELECT CAST(qid AS VARCHAR) AS qid, CASE WHEN unsafe THEN coalesce(safety, no_info, block, 'A') ELSE coalesce(sound, {S_HEURISTIC}, 'A') END AS answer,
       CASE WHEN unsafe THEN 'BLOCKED-AI-BLOCKED' WHEN turn = 5 THEN 'REGEX-FALLBACK' ELSE 'AI-' || (['STEM', 'LEGAL', 'SOCIAL', 'SOCIAL'])[turn] || CASE WHEN large THEN '-L' ELSE '-S' END END AS tag,
       CASE WHEN unsafe THEN 'blocked' WHEN said = '' THEN 'fallback' ELSE 'replied' END AS status, CASE WHEN NOT unsafe THEN CASE WHEN large THEN 'large' ELSE 'small' END END AS model
FROM z"""


@query(S_ANSWERS)
def answers_by_route(spark, d):
    """All items through the whole pipeline: the model by route and the other one where it is silent, the second try without knowledge, hint and trap checks, heuristics [P6, P7, P8, P11, P12, P18, P19]."""
    chunks = stored(answered_from(chunking.chunk_articles(from_documents(tbl(spark, d, "documents")), "sub")))
    ask = F.element_at(F.array(*[F.lit(x) for x in ASKS]), (F.col("qid") % len(ASKS) + 1).cast("int"))
    text = F.concat(ask, "question", F.lit(" qq"), F.col("qid").cast("string"), F.lit("qq"))
    questions = refusal_questions(spark, d).select(F.col("qid").cast("string").alias("qid"), text.alias("question"), "choices")
    points = embed(chunks.select("chunk_id", "vector_text"), HashedEmbedder(), "vector_text").select("chunk_id", "vector")
    vectors = embed(questions.select("qid", "question"), HashedEmbedder(), "question").select("qid", "vector")
    return answer(questions, chunks, points, vectors, Router(), Large(), small=Small(), at_once=4)
