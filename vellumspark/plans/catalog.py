"""The engine's queries over the driver's tables, each with the SQL it equals where SQL can say it.

chunks are ``documents``, questions ``benchmark``, vectors ``embeddings`` (query
item i uses vector i; vec_id stands for doc_id in fusion), replies and routed
questions ``conversations``, truth ``labels``, pages ``pages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions import text as t
from ..functions import words as w
from ..operators import chunking, pages, retrieval, tables
from ..providers import HashedEmbedder, OfflineChat, embed
from ..schemas import from_documents
from ..storage import cut, stored, work_folder
from ..streaming import jobs
from .answering import answer, answered_from

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def tbl(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents, dealt to all cores where they are small."""
    return retrieval.spread(tbl(spark, d, "documents"))


# --- SQL pieces


def s_lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def s_any(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {s_lit(p)})" for p in phrases) + ")"


def s_match(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {s_lit(p)})" for p in patterns) + ")"


S_TOKENS = "list_filter(regexp_split_to_array(translate(lower(coalesce({0}, '')), {1}, {2}), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"


def s_tokens(column: str) -> str:
    return S_TOKENS.format(column, s_lit(w.PUNCTUATION), s_lit(" " * len(w.PUNCTUATION)))


S_OPTIONS = """q AS (SELECT item_id AS qid, text AS question,
  list_transform([0, 1, 2, 3], lambda j: array_to_string(list_slice(string_split(text, ' '), j * 3 + 1, j * 3 + 3), ' ') || ' ' || CAST((item_id * (j + 3)) % 17 AS VARCHAR)) AS opts FROM benchmark)"""


def option_questions(spark: SparkSession, d: str) -> DataFrame:
    """Four options for each item: three words of its text and a small number each."""
    words = F.split("text", " ")
    choices = [F.concat(F.array_join(F.slice(words, j * 3 + 1, 3), " "), F.lit(" "), ((F.col("item_id") * (j + 3)) % 17).cast("string")) for j in range(4)]
    return tbl(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.array(*choices).alias("choices")).withColumn("options", r.options(F.col("choices")))


# --- retrieval

S_BM25 = f"""d AS (SELECT doc_id AS chunk_id, {s_tokens('text')} AS tokens FROM documents),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
p AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM p GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({s_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT qid, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM qt JOIN p USING (term) JOIN df USING (term), st GROUP BY qid, chunk_id),
sr AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INT) AS rank FROM sc WHERE score > 0)"""
S_DENSE = """vq AS (SELECT vec_id AS qid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS qv FROM embeddings WHERE {0}),
vp AS (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
vs AS (SELECT qid, chunk_id, round(list_cosine_similarity(qv, v), 6) AS score FROM vq, vp),
dr AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INT) AS rank FROM vs)"""
#: The queries: vectors whose id is divisible by 20, or those of the benchmark's items
S_ASKED, S_ITEMS = S_DENSE.format("vec_id % 20 = 0"), S_DENSE.format("vec_id IN (SELECT item_id FROM benchmark)")


def bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    return retrieval.bm25_search(texts(spark, d), tbl(spark, d, "benchmark"), k, "doc_id", "text", "item_id", "text")


def dense_of(spark: SparkSession, d: str, k: int, asked: DataFrame) -> DataFrame:
    """The dense leg of all asked rows of the vectors, in blocks."""
    return retrieval.dense_search_blocks(tbl(spark, d, "embeddings"), asked.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), k)


def asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return tbl(spark, d, "embeddings").filter("vec_id % 20 = 0")


def dense_items(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The dense leg of every benchmark item that has a vector."""
    items = tbl(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    return dense_of(spark, d, k, tbl(spark, d, "embeddings").join(items, "vec_id", "left_semi"))


@query(f"WITH {S_BM25} SELECT qid, chunk_id, score, rank FROM sr WHERE rank <= 10")
def bm25_topk(spark, d):
    return bm25(spark, d, 10)


@query(f"WITH {S_BM25} SELECT term, df, CAST(cf AS BIGINT) AS cf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def bm25_term_stats(spark, d):
    index = retrieval.build_bm25(texts(spark, d), "doc_id", "text")
    n = index["corpus_stats"].first()["n_docs"]
    return index["term_stats"].select("term", "df", "cf", F.round(retrieval.idf(F.lit(n), F.col("df")), 6).alias("idf"))


@query(f"WITH {S_BM25} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM st")
def bm25_corpus_stats(spark, d):
    return retrieval.build_bm25(texts(spark, d), "doc_id", "text")["corpus_stats"].select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {S_ASKED} SELECT qid, chunk_id, score, rank FROM dr WHERE rank <= 10")
def dense_topk(spark, d):
    return dense_of(spark, d, 10, asked_vectors(spark, d))


@query(f"WITH {S_ASKED} SELECT qid, chunk_id, score, label FROM dr JOIN embeddings ON vec_id = chunk_id WHERE rank <= 5")
def dense_payload(spark, d):
    asked = asked_vectors(spark, d)
    return retrieval.with_payload(dense_of(spark, d, 5, asked), tbl(spark, d, "embeddings"), "vec_id", ["label"], 5 * asked.count()).select("qid", "chunk_id", "score", "label")


def _fusion(score: str, dense_rows: str = "SELECT qid, chunk_id, score FROM dr WHERE rank <= 10", sparse_rows: str = "SELECT qid, chunk_id, score FROM sr WHERE rank <= 20") -> str:
    ranked = lambda x: f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS r, max(score) OVER (PARTITION BY qid) AS m FROM ({x})"
    return f"""WITH {S_BM25}, {S_ITEMS}, s AS ({ranked(sparse_rows)}), v AS ({ranked(dense_rows)}),
f AS (SELECT qid, chunk_id, {score} AS score FROM v FULL OUTER JOIN s USING (qid, chunk_id)),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INT) AS rank FROM f)
SELECT qid, chunk_id, score, rank FROM fr WHERE rank <= 10"""


def legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The sparse and the dense hits of all benchmark items; k rows an item, stored because fusion reads them more than once."""
    return cut(bm25(spark, d, 20)), cut(dense_items(spark, d, 10))


COMPAT = "SELECT qid, chunk_id, score FROM dr WHERE rank <= 10 UNION ALL (SELECT qid, chunk_id, 0.0 FROM sr WHERE rank <= 20 AND (qid, chunk_id) NOT IN (SELECT (qid, chunk_id) FROM dr WHERE rank <= 10))"
S_RRF = "round(coalesce(0.5 / (60 + v.r), 0) + coalesce(0.5 / (60 + s.r), 0), 8)"
S_MAX_NORM = "round(0.5 * coalesce(CASE WHEN v.m > 0 THEN v.score / v.m ELSE 0 END, 0) + 0.5 * coalesce(CASE WHEN s.m > 0 THEN s.score / s.m ELSE 0 END, 0), 8)"


@query(_fusion(S_RRF))
def hybrid_rrf(spark, d):
    return retrieval.fuse_ranks(*legs(spark, d), 10)


@query(_fusion(S_RRF, COMPAT))
def hybrid_rrf_compat(spark, d):
    return retrieval.fuse_ranks(*legs(spark, d), 10, compat=True)


@query(_fusion("round(coalesce(0.5 / (60 + v.r), 0.5 / 10059) + coalesce(0.5 / (60 + s.r), 0.5 / 10059), 8)"))
def hybrid_rrf_9999(spark, d):
    return retrieval.fuse_ranks(*legs(spark, d), 10, absent=9999)


@query(_fusion(S_MAX_NORM))
def hybrid_max_norm(spark, d):
    return retrieval.fuse_max_norm(*legs(spark, d), 10)


@query(_fusion(S_MAX_NORM, sparse_rows="SELECT qid, chunk_id, score FROM (SELECT *, max(CASE WHEN rank = pos THEN score END) OVER (PARTITION BY qid) AS bound FROM (SELECT *, floor(count(*) OVER (PARTITION BY qid) * 0.3) + 1 AS pos FROM sr WHERE rank <= 20)) WHERE score >= greatest(1.0, bound)"))
def hybrid_threshold(spark, d):
    return retrieval.fuse_max_norm(*legs(spark, d), 10, least=1.0, share=0.3)


@query(f"WITH {S_BM25}, {S_ITEMS} {COMPAT}")
def payload_complete(spark, d):
    return retrieval.complete_payload(*legs(spark, d))


@query(f"""WITH {S_BM25} SELECT qid, len(string_agg(body, chr(10) || chr(10) ORDER BY rank)) AS n_chars, sha256(string_agg(body, chr(10) || chr(10) ORDER BY rank)) AS block
FROM (SELECT qid, rank, '[' || rank || '] ' || substring(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 2000) AS body FROM sr JOIN documents ON doc_id = chunk_id WHERE rank <= 8) GROUP BY qid""")
def context_block(spark, d):
    found = retrieval.with_payload(bm25(spark, d, 8), retrieval.spread(tbl(spark, d, "documents")), "doc_id", ["text"], 8 * tbl(spark, d, "benchmark").count())
    listed = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    block = r.context_block(F.col("texts"), 2000, first=8, squeezed=True)
    return listed.select("qid", F.length(block).alias("n_chars"), F.sha2(block, 256).alias("block"))


# --- bookkeeping


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_first(spark, d):
    return tables.keep_first(tbl(spark, d, "documents").select("text", "doc_id", "source"), ["text"], ["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, d):
    return tables.remaining(tbl(spark, d, "documents").select("doc_id", "lang"), tbl(spark, d, "labels"), "doc_id")


# all documents are on the existing side, the even ones come again as a second version


@query("""SELECT doc_id, arg_max(source, (n_chars, new)) AS source, max(n_chars) AS n_chars FROM (
  SELECT doc_id, source, n_chars, 0 AS new FROM documents UNION ALL
  SELECT doc_id, 'new' AS source, n_chars, 1 AS new FROM documents WHERE doc_id % 2 = 0) GROUP BY doc_id""")
def state_upsert(spark, d):
    docs = tbl(spark, d, "documents").select("doc_id", "source", "n_chars")
    return tables.upsert(docs, docs.filter("doc_id % 2 = 0").withColumn("source", F.lit("new")), "doc_id", "n_chars")


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT -1 - doc_id, 'new' FROM documents WHERE doc_id % 2 = 1")
def insert_ignore(spark, d):
    docs = tbl(spark, d, "documents").select("doc_id", "lang")
    again = docs.withColumns({"doc_id": F.expr("CASE WHEN doc_id % 2 = 1 THEN -1 - doc_id ELSE doc_id END"), "lang": F.lit("new")})
    return tables.insert_or_ignore(docs, again, "doc_id")


@query("SELECT md5(url) AS url_hash, url FROM pages")
def url_md5(spark, d):
    return pages.crawl_state(tbl(spark, d, "pages"))


@query("SELECT url, count(*) AS n FROM pages GROUP BY url HAVING count(*) > 1")
def key_collisions(spark, d):
    return tables.duplicates(tbl(spark, d, "pages"), ["url"])


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS INT) AS batch FROM conversations")
def batch_numbers(spark, d):
    return tables.batch_numbers(tbl(spark, d, "conversations").select("conv_id", "turn"), "turn", 3, "conv_id")


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS asked FROM conversations""")
def carry_context(spark, d):
    rows = tbl(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("asked"))
    return tables.carry_forward(rows, "asked", "conv_id", "turn").withColumn("asked", F.coalesce("asked", F.lit(-1)))


@query("SELECT DISTINCT lang AS value FROM documents UNION SELECT DISTINCT source FROM documents")
def union_distinct(spark, d):
    docs = tbl(spark, d, "documents")
    return docs.select(F.col("lang").alias("value")).union(docs.select("source")).distinct()


# --- reports


@query("SELECT count(*) AS checked, CAST(count_if(quality = toxic) AS BIGINT) AS correct, round(100.0 * count_if(quality = toxic) / count(*), 4) AS accuracy FROM labels")
def accuracy(spark, d):
    labels = tbl(spark, d, "labels")
    return tables.accuracy(labels.select(F.col("doc_id").alias("qid"), F.col("quality").alias("answer")), labels.select(F.col("doc_id").alias("qid"), F.col("toxic").alias("answer")))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def value_counts(spark, d):
    return tables.value_counts(tbl(spark, d, "documents"), "source")


@query("""SELECT count(l) AS n, round(avg(l), 4) AS mean, round(stddev_samp(l), 4) AS std, min(l) AS least, quantile_cont(l, 0.25) AS q1, quantile_cont(l, 0.5) AS median, quantile_cont(l, 0.75) AS q3, max(l) AS most
FROM (SELECT CAST(length(text) AS DOUBLE) AS l FROM documents)""")
def length_summary(spark, d):
    return tables.length_summary(tbl(spark, d, "documents"), "text")


@query("SELECT CAST(least(greatest(floor(length(text) / 200.0), 0), 49) AS INT) AS bin, count(*) AS n FROM documents GROUP BY 1")
def length_hist(spark, d):
    return tables.histogram(tbl(spark, d, "documents"), F.length("text"), 0, 10_000, 50)


@query("SELECT doc_id, length(text) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 5")
def longest_five(spark, d):
    return tbl(spark, d, "documents").select("doc_id", F.length("text").alias("n")).orderBy(F.desc("n"), "doc_id").limit(5)


@query("""SELECT issue, count(*) AS n FROM (SELECT CASE WHEN length(text) = 0 THEN 'empty' WHEN i = '' THEN 'OK' ELSE i END AS issue FROM (
  SELECT text, concat_ws(', ', CASE WHEN regexp_matches(text, '^[a-zà-ỹ]') THEN 'lower-case start' END, CASE WHEN right(text, 1) NOT IN ('.', '!', '?', '"', '''') THEN 'no final mark' END) AS i FROM documents)) GROUP BY issue""")
def syntax_quality(spark, d):
    return texts(spark, d).select(t.syntax_issues(F.col("text")).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


# --- text


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 800")
def min_length(spark, d):
    return tbl(spark, d, "documents").select("doc_id", F.length("text").alias("n")).filter("n >= 800")


@query(rf"SELECT doc_id, len({s_tokens('text')}) AS n_tokens, len(list_distinct({s_tokens('text')})) AS n_distinct FROM documents")
def tokens_clean(spark, d):
    words = t.tokens(F.col("text"))
    return texts(spark, d).select("doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"))


@query(r"SELECT doc_id, CAST(floor(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) * 1.3) AS BIGINT) AS approx FROM documents")
def approx_tokens(spark, d):
    return texts(spark, d).select("doc_id", t.approx_tokens(F.col("text")).alias("approx"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS squeezed FROM documents")
def squeeze_space(spark, d):
    return texts(spark, d).select("doc_id", F.sha2(t.squeeze(F.col("text")), 256).alias("squeezed"))


@query(rf"SELECT doc_id, length(regexp_replace(text || '[12] end[x][3]', '{w.CITATION_DIGITS}', '', 'g')) AS digits_only, length(regexp_replace(text || '[12] [cần dẫn nguồn]', '{w.CITATION}', '', 'g')) AS phrases FROM documents")
def citation_strip(spark, d):
    both = [t.strip_citations(F.concat("text", F.lit("[12] end[x][3]"))), t.strip_citations(F.concat("text", F.lit("[12] [cần dẫn nguồn]")), digits_only=False)]
    return texts(spark, d).select("doc_id", F.length(both[0]).alias("digits_only"), F.length(both[1]).alias("phrases"))


@query(f"""WITH x AS (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || '== Tham khảo ==' || chr(10) || text ELSE text END, chr(10)) AS lines FROM documents),
m AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda l: length(trim(l)) < 50 AND (starts_with(trim(l), '=') OR starts_with(trim(l), '#') OR l = upper(l)) AND list_contains([{", ".join(map(s_lit, w.FOOTER_STEM))}], trim(lower(trim(l)), '=#-:. '))), true) AS pos FROM x)
SELECT doc_id, length(array_to_string(CASE WHEN pos > 0 THEN list_slice(lines, 1, pos - 1) ELSE lines END, chr(10))) AS n FROM m""")
def footer_cut(spark, d):
    docs = texts(spark, d)
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n== Tham khảo ==\n"), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", F.length(t.cut_footer(text)).alias("n"))


@query(f"""WITH x AS (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || 'Đọc thêm:' || chr(10) || text ELSE text END, chr(10)) AS lines FROM documents),
m AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda l: length(trim(l)) < 40 AND list_contains([{", ".join(map(s_lit, w.FOOTER_WIKI))}], trim(lower(trim(l)), '.:-='))), true) AS pos FROM x)
SELECT doc_id, length(array_to_string(CASE WHEN pos > 0 THEN list_slice(lines, 1, pos - 1) ELSE lines END, chr(10))) AS n FROM m""")
def footer_cut_wiki(spark, d):
    docs = texts(spark, d)
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\nĐọc thêm:\n"), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", F.length(t.cut_footer_wiki(text)).alias("n"))


S_FLAGS = {
    "has_math": s_match("{0}", w.MATH_STEM),
    "has_formula": s_match("{0}", [*w.FORMULA_STEM, r"(?:^|[^\p{{L}}\p{{N}}_])" + w.FORMULA_ASSIGN]),
    "has_table": "len(list_filter(string_split({0}, chr(10)), lambda l: starts_with(ltrim(l), '|'))) >= 2",
    "has_list": f"len(list_filter(string_split({{0}}, chr(10)), lambda l: regexp_matches(l, '^(?:{w.LIST_ITEM})'))) >= 2",
    "has_legal": s_match("lower({0})", w.LEGAL_STEM),
}


def s_flag(name: str, column: str) -> str:
    return S_FLAGS[name].replace("{0}", column).replace("{{", "{").replace("}}", "}")


S_WORDS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'))"


@query("SELECT doc_id, " + ", ".join(f"{s_flag(n, 'text')} AS {n}" for n in S_FLAGS) + f", {S_WORDS.format('text')} >= 20 AS is_substantial FROM documents")
def content_flags(spark, d):
    return retrieval.spread(tbl(spark, d, "documents").select("doc_id", "text")).select("doc_id", *[c.alias(n) for n, c in t.content_flags(F.col("text")).items()])


@query(f"SELECT doc_id, {s_match('text', [w.MATH_SUB])} AS has_math, {s_match('lower(text)', [w.LEGAL_SUB])} AS has_legal, {S_WORDS.format('text')} >= 15 AS is_substantial FROM documents")
def content_flags_sub(spark, d):
    return texts(spark, d).select("doc_id", *[c.alias(n) for n, c in t.content_flags_sub(F.col("text")).items()])


# the filters read every paragraph of the text (a table needs two lines)

S_PARTS = "(SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS part, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ls FROM documents))"


def parts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, part, l): all paragraphs of all texts."""
    docs = retrieval.spread(tbl(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("part", "l"))


@query(f"SELECT doc_id, part, length(l) AS n FROM {S_PARTS} WHERE length(l) >= 50 OR {s_flag('has_formula', 'l')} OR {s_flag('has_table', 'l')} OR {s_flag('has_legal', 'l')}")
def keep_chunk_stem(spark, d):
    return parts(spark, d).filter(t.keep_chunk_stem(F.col("l"))).select("doc_id", "part", F.length("l").alias("n"))


@query(f"SELECT doc_id, part, length(l) AS n FROM {S_PARTS} WHERE length(l) >= 50 OR {s_match('l', [w.MATH_SUB])} OR {s_match('lower(l)', [w.LEGAL_SUB])} OR ({s_any('l', w.TIMELINE)} AND regexp_matches(l, '\\d'))")
def keep_chunk_sub(spark, d):
    return parts(spark, d).filter(t.keep_chunk_sub(F.col("l"))).select("doc_id", "part", F.length("l").alias("n"))


@query(f"SELECT doc_id, part, length(l) AS n FROM {S_PARTS} WHERE (length(l) >= 30 OR ({s_any('l', w.TIMELINE)} AND regexp_matches(l, '\\d'))) AND NOT (contains(l, 'Mục lục') AND length(l) < 50)")
def keep_chunk_wiki(spark, d):
    return parts(spark, d).filter(t.keep_chunk_wiki(F.col("l"))).select("doc_id", "part", F.length("l").alias("n"))


CATEGORY = "CASE doc_id % 4 WHEN 0 THEN 'Toán_học > Đại_số > ' || source WHEN 1 THEN lang || ' > ' || source WHEN 2 THEN source ELSE 'Bộ_luật > ' || lang END"


def category() -> F.Column:
    return F.expr(CATEGORY)


S_SHORT = "CASE replace(p[1], '_', ' ') " + " ".join(f"WHEN {s_lit(a)} THEN {s_lit(b)}" for a, b in w.CATEGORY_SHORT.items()) + " ELSE replace(p[1], '_', ' ') END"


@query(f"""SELECT doc_id, CASE WHEN len(p) = 1 THEN replace(p[1], '_', ' ') ELSE {S_SHORT} || '-' || replace(p[-1], '_', ' ') END AS short,
replace(CASE WHEN len(p) > 1 THEN string_split(p[1], '_')[1] || '-' || p[-1] ELSE p[1] END, '_', ' ') AS short_sub
FROM (SELECT doc_id, list_transform(string_split({CATEGORY}, '>'), lambda x: trim(x)) AS p FROM documents)""")
def category_short(spark, d):
    return tbl(spark, d, "documents").select("doc_id", t.short_category(category()).alias("short"), t.short_category_sub(category()).alias("short_sub"))


@query(f"""SELECT doc_id, CASE WHEN {s_any('c', w.STEM_DOMAIN)} THEN 'stem' WHEN {s_any('c', w.LEGAL_DOMAIN)} THEN 'legal' ELSE 'general' END AS domain,
CASE WHEN {s_any('c', w.STEM_DOMAIN_SUB)} THEN 'stem' WHEN {s_any('c', w.LEGAL_DOMAIN_SUB)} THEN 'legal' ELSE 'general' END AS domain_sub
FROM (SELECT doc_id, lower({CATEGORY}) AS c FROM documents)""")
def domain_detect(spark, d):
    return tbl(spark, d, "documents").select("doc_id", t.domain(category()).alias("domain"), t.domain(category(), w.STEM_DOMAIN_SUB, w.LEGAL_DOMAIN_SUB).alias("domain_sub"))


@query("SELECT doc_id, sha256('Lĩnh vực: ' || replace(lang, '_', ' ') || '. Chủ đề: doc_' || doc_id || '.' || chr(10) || 'Nội dung: ' || text) AS wiki, sha256('[' || lang || ' > ' || source || '] ' || text) AS stem, sha256('[' || source || '] doc_' || doc_id || chr(10) || text) AS sub FROM documents")
def context_prefix(spark, d):
    title = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    path = t.category_path(F.array("lang", "source"))
    wiki, stem, sub = t.prefix_wiki(t.first_category(F.array("lang", "source")), title, F.col("text")), t.prefix_stem(path, F.col("text")), t.prefix_sub(F.col("source"), title, F.col("text"))
    return tbl(spark, d, "documents").select("doc_id", F.sha2(wiki, 256).alias("wiki"), F.sha2(stem, 256).alias("stem"), F.sha2(sub, 256).alias("sub"))


@query("""SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS id
FROM (SELECT 'doc_' || doc_id || '_0' AS chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc_' || doc_id || '_0')) AS h FROM documents)""")
def chunk_uuid5(spark, d):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_0"))
    return tbl(spark, d, "documents").select(name.alias("chunk_id"), t.uuid5(name).alias("id"))


# --- rules over questions; the texts get a phrase by row number so that every rule is met

PHRASES = [
    "", "Theo đoạn văn bản sau", "Cách làm giả giấy tờ", "Tính $x^2$ bằng công thức", "xxx", "giết người theo luật",
    "vũ khí", "Giả sử suy ra", "tính cách nhân vật", "Bao nhiêu phần trăm", "làm sao trốn thuế và lách luật công an",
]
S_PHRASED = f"SELECT conv_id, turn, ([{', '.join(map(s_lit, PHRASES))}])[(conv_id + turn) % {len(PHRASES)} + 1] || ' ' || text AS q FROM conversations"


def phrased(spark: SparkSession, d: str) -> DataFrame:
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("conv_id") + F.col("turn")) % len(PHRASES) + 1).cast("int"))
    return tbl(spark, d, "conversations").select("conv_id", "turn", F.concat(phrase, F.lit(" "), "text").alias("q"))


@query(f"SELECT conv_id, turn, {s_any('lower(q)', w.CRITICAL)} AS critical FROM ({S_PHRASED})")
def critical_flag(spark, d):
    return phrased(spark, d).select("conv_id", "turn", r.critical(F.col("q")).alias("critical"))


@query(f"SELECT conv_id, turn, CASE WHEN {s_any('l', w.HARD_BAN)} THEN 'SENSITIVE' WHEN {s_any('l', w.SOFT_BAN)} AND NOT {s_any('l', w.WHITELIST)} THEN 'SUSPICIOUS' ELSE 'SAFE' END AS state FROM (SELECT *, lower(q) AS l FROM ({S_PHRASED}))")
def sensitive_state(spark, d):
    return phrased(spark, d).select("conv_id", "turn", r.sensitive(F.col("q")).alias("state"))


@query(f"""SELECT conv_id, turn, CASE WHEN {s_any('l', w.ACADEMIC)} THEN 'REGEX-ACADEMIC' WHEN {s_any('l', w.DIRTY)} THEN 'BLOCKED-REGEX-DIRTY' WHEN {s_match('l', [w.BAD_INTENT])} THEN 'BLOCKED-REGEX-INTENT' ELSE 'REGEX-FALLBACK' END AS tag,
{s_match('l', [w.MATH_HINT])} AND NOT {s_any('l', w.ACADEMIC)} AND NOT {s_any('l', w.DIRTY)} AND NOT {s_match('l', [w.BAD_INTENT])} AS is_stem
FROM (SELECT *, lower(q) AS l FROM ({S_PHRASED}))""")
def route_rules(spark, d):
    route = r.route_rules(F.col("q"), r.options(F.array(F.lit("yes"), F.lit("no"))))
    return phrased(spark, d).select("conv_id", "turn", route.alias("x")).select("conv_id", "turn", "x.tag", "x.is_stem")


@query(f"""SELECT conv_id, turn, CASE WHEN {s_any('l', w.FOUR_HARD_BAN)} OR ({s_any('l', w.FOUR_SOFT_BAN)} AND NOT {s_any('l', w.FOUR_WHITELIST)}) THEN 'BLOCKED'
WHEN {s_match('q', [w.FOUR_MATH])} OR {s_any('l', w.FOUR_STEM)} OR (contains(l, '{w.FOUR_CALCULATE}') AND NOT {s_any('l', w.FOUR_NOT_CALCULATE)}) THEN 'STEM' WHEN {s_any('l', w.FOUR_LOGIC)} THEN 'COMPLEX' ELSE 'SIMPLE' END AS class
FROM (SELECT *, lower(q) AS l FROM ({S_PHRASED}))""")
def route_four_class(spark, d):
    return phrased(spark, d).select("conv_id", "turn", r.route_four(F.col("q")).alias("class"))


@query(f"SELECT conv_id, turn, {s_any('lower(q)', w.OLD_BLACKLIST)} AND NOT {s_any('lower(q)', w.OLD_WHITELIST)} AS sensitive, {s_match('q', [w.MATH_HARD])} AS is_math, {s_any('lower(q)', w.LEGAL_HARD)} AS is_legal FROM ({S_PHRASED})")
def sensitive_old(spark, d):
    axes = r.hard_axes(F.col("q"))
    return phrased(spark, d).select("conv_id", "turn", r.sensitive_topic(F.col("q")).alias("sensitive"), axes["is_math"].alias("is_math"), axes["is_legal"].alias("is_legal"))


@query(f"SELECT tag, count(*) AS n, CAST(count_if(starts_with(tag, 'BLOCKED')) AS BIGINT) AS n_blocked FROM (SELECT CASE WHEN {s_any('l', w.ACADEMIC)} THEN 'REGEX-ACADEMIC' WHEN {s_any('l', w.DIRTY)} THEN 'BLOCKED-REGEX-DIRTY' WHEN {s_match('l', [w.BAD_INTENT])} THEN 'BLOCKED-REGEX-INTENT' ELSE 'REGEX-FALLBACK' END AS tag FROM (SELECT lower(q) AS l FROM ({S_PHRASED}))) GROUP BY tag")
def router_report(spark, d):
    return route_rules(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tag").startswith("BLOCKED")).alias("n_blocked"))


REFUSALS = ["Tôi không thể trả lời câu hỏi này", "Không đủ thông tin để kết luận", "Luật không có thông tin", "Không thể xác định.", "Tất cả các ý trên", "Hành vi vi phạm pháp luật bị coi là tội"]
S_REFUSAL = f"r AS (SELECT qid, list_transform(opts, lambda o, i: CASE WHEN (qid + i - 1) % 3 = 0 THEN ([{', '.join(map(s_lit, REFUSALS))}])[(qid * 5 + i - 1) % {len(REFUSALS)} + 1] ELSE o END) AS opts FROM q)"


def refusal_questions(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array(*[F.lit(x) for x in REFUSALS])
    pick = lambda o, i: F.when((F.col("qid") + i) % 3 == 0, F.element_at(texts, ((F.col("qid") * 5 + i) % len(REFUSALS) + 1).cast("int"))).otherwise(o)
    return option_questions(spark, d).select("qid", "question", F.transform("choices", pick).alias("choices")).withColumn("options", r.options(F.col("choices")))


def s_first(test: str) -> str:
    return f"chr(64 + CAST(list_position(list_transform(opts, lambda o: {test}), true) AS INT))"


def s_key(test: str) -> str:
    return f"CASE WHEN list_contains(list_transform(opts, lambda o: {test}), true) THEN {s_first(test)} END"


S_SAFETY = f"NOT {s_any('lower(o)', w.SAFETY_EXCLUSIONS)} AND {s_match('trim(lower(o))', w.SAFETY_PATTERNS)}"
S_NO_INFO = f"NOT {s_any('lower(o)', w.NO_INFO_SKIP + w.NO_INFO_EXCLUSIONS)} AND {s_match('trim(lower(o))', w.NO_INFO_PATTERNS)}"
S_NO_INFO_WIDE = f"NOT {s_any('lower(o)', w.NO_INFO_WIDE_SKIP + w.NO_INFO_WIDE_EXCLUSIONS)} AND {s_match('trim(lower(o))', w.NO_INFO_WIDE_PATTERNS)}"


@query(f"WITH {S_OPTIONS}, {S_REFUSAL} SELECT qid, coalesce({s_key(S_SAFETY)}, {s_key(S_NO_INFO)}) AS refusal_key, CASE WHEN {s_key(S_SAFETY)} IS NOT NULL THEN 'SAFETY' WHEN {s_key(S_NO_INFO)} IS NOT NULL THEN 'NO_INFO' END AS refusal_type FROM r")
def refusal_first(spark, d):
    return refusal_questions(spark, d).select("qid", r.refusal_key(F.col("options")).alias("refusal_key"), r.refusal_type(F.col("options")).alias("refusal_type"))


@query(f"WITH {S_OPTIONS}, {S_REFUSAL} SELECT qid, {s_key(S_NO_INFO_WIDE)} AS no_info_key, {s_key(s_match('lower(o)', w.ALL_ABOVE))} AS all_above_key FROM r")
def no_info_first(spark, d):
    above = F.get(F.filter("options", lambda o: r.all_above(o["text"])), F.lit(0))["key"]
    return refusal_questions(spark, d).select("qid", r.no_info_key(F.col("options")).alias("no_info_key"), above.alias("all_above_key"))


# --- answers


@query(f"WITH {S_OPTIONS} SELECT qid, unnest(['A', 'B', 'C', 'D']) AS key, unnest(opts) AS text FROM q")
def options_map(spark, d):
    return option_questions(spark, d).select("qid", F.explode("options").alias("o")).select("qid", "o.key", "o.text")


def s_argmax(score: str) -> str:
    scores = f"list_transform(opts, lambda o: {score})"
    return f"chr(64 + CAST(list_position({scores}, list_max({scores})) AS INT))"


@query(f"WITH {S_OPTIONS} SELECT qid, {s_argmax(f'len(list_intersect({s_tokens("o")}, {s_tokens("question")}))')} AS answer FROM q")
def overlap_answer(spark, d):
    return option_questions(spark, d).select("qid", r.overlap_answer(F.col("question"), F.col("options")).alias("answer"))


@query(f"WITH {S_OPTIONS} SELECT qid, {s_argmax('length(o)')} AS answer FROM q")
def longest_answer(spark, d):
    return option_questions(spark, d).select("qid", r.longest_answer(F.col("options")).alias("answer"))


ASKS = ["", "Giá trị lớn nhất ", "Giá trị nhỏ nhất ", "Giảm bao nhiêu ", "Vận tốc theo m/s "]
S_NUMBER = "TRY_CAST(regexp_extract(o, '([0-9.]+)', 1) AS DOUBLE)"


@query(f"""WITH {S_OPTIONS}, a AS (SELECT qid, ([{', '.join(map(s_lit, ASKS))}])[qid % {len(ASKS)} + 1] || question AS question, opts FROM q),
n AS (SELECT *, list_filter(['A', 'B', 'C', 'D'], lambda k: regexp_matches(opts[ascii(k) - 64], '[0-9]')) AS numeric,
 nullif(regexp_extract(lower(question), '(?:^|[^\\p{{L}}\\p{{N}}_])({w.UNITS})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '') AS unit FROM a)
SELECT qid, coalesce(CASE WHEN unit IS NOT NULL THEN {s_key("contains(lower(o), unit)")} END,
 CASE WHEN {s_any('lower(question)', w.CHANGE_WORDS)} THEN {s_key(s_any('lower(o)', ['%', '+', 'tăng']))} END,
 CASE WHEN {s_any('lower(question)', w.MOST_WORDS)} THEN {s_argmax(S_NUMBER)} END,
 CASE WHEN {s_any('lower(question)', w.LEAST_WORDS)} THEN {s_argmax('-' + S_NUMBER)} END,
 numeric[len(numeric) // 2 + 1], 'C') AS answer FROM n""")
def math_answer(spark, d):
    ask = F.concat(F.element_at(F.array(*[F.lit(x) for x in ASKS]), (F.col("qid") % len(ASKS) + 1).cast("int")), "question")
    return option_questions(spark, d).select("qid", r.math_answer(ask, F.col("options")).alias("answer"))


#: How a letter stands in a reply: by turns at the end of, before or inside the conversation's own text
REPLIES = ["{t}\n### ĐÁP ÁN: {x}", "đáp án: {x}\n{t}", "{t} Chọn {x}", "{t}\nKết luận: {x}", "{x}.", "{x}", "{t} Vậy **{x}** đúng", "{t} **Z** rồi **{x}**", "{t}", "{t}\nĐáp án Z. Chọn: {x}", "{t} là ({x})"]
S_LETTER = "chr(65 + CAST((length(text) + turn) % 5 AS INT))"
S_REPLIES = f"""r AS (SELECT conv_id, turn, CASE (conv_id + turn) % {len(REPLIES)} {" ".join(f"WHEN {i} THEN replace(replace({s_lit(x)}, '{{x}}', {S_LETTER}), '{{t}}', text)" for i, x in enumerate(REPLIES))} END AS reply FROM conversations WHERE role = 'assistant')"""


def replies(spark: SparkSession, d: str) -> tuple[DataFrame, F.Column]:
    """Replies made of the assistants' texts and a letter from A to E, of which A to D are options."""
    letter = F.chr(65 + (F.length("text") + F.col("turn")) % 5)
    shapes = F.element_at(F.array(*[F.lit(x) for x in REPLIES]), ((F.col("conv_id") + F.col("turn")) % len(REPLIES) + 1).cast("int"))
    reply = F.replace(F.replace(shapes, F.lit("{x}"), letter), F.lit("{t}"), F.col("text"))
    opts = r.options(F.array(*[F.lit(x) for x in ("one", "two", "three", "four")]))
    return tbl(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", reply.alias("reply")), opts


def s_valid(letter: str) -> str:
    return f"CASE WHEN upper({letter}) IN ('A', 'B', 'C', 'D') THEN upper({letter}) END"


S_LOW = "lower(trim(reply))"
S_STRICT = [s_valid(f"regexp_extract({S_LOW}, {s_lit(p)}, 1)") for p in w.ANSWER_STRICT]
S_BOLD_LAST = s_valid("list_extract(regexp_extract_all(trim(reply), '\\*\\*([A-Z])\\*\\*', 1), -1)")
S_LOOSE = [s_valid(f"regexp_extract({S_LOW}, {s_lit(p)}, 1)") for p in w.ANSWER_LOOSE]


@query(f"WITH {S_REPLIES} SELECT conv_id, turn, coalesce({', '.join([*S_STRICT, S_BOLD_LAST, *S_LOOSE])}) AS answer FROM r")
def extract_answer(spark, d):
    found, opts = replies(spark, d)
    return found.select("conv_id", "turn", r.extract_answer(F.col("reply"), opts).alias("answer"))


@query(f"WITH {S_OPTIONS} SELECT qid, CASE WHEN {s_any('lower(question)', w.NEGATIVE_WORDS)} OR qid % 3 = 0 THEN {s_argmax('length(o)')} ELSE {s_argmax(f'len(list_intersect({s_tokens("o")}, {s_tokens("question")}))')} END AS answer FROM q")
def overlap_answer_negated(spark, d):
    asked = F.when(F.col("qid") % 3 == 0, F.concat("question", F.lit(" ngoại trừ"))).otherwise(F.col("question"))
    return option_questions(spark, d).select("qid", r.overlap_answer_negated(asked, F.col("options")).alias("answer"))


S_LONE = "list_extract(list_filter(list_transform(regexp_extract_all(' ' || regexp_replace(trim(reply), '([^\\p{L}\\p{N}_])', '\\1 ', 'g') || ' ', '[^\\p{L}\\p{N}_][A-Z][^\\p{L}\\p{N}_]'), lambda x: substr(x, 2, 1)), lambda x: x IN ('A', 'B', 'C', 'D')), -1)"
S_BOLD_FIRST = s_valid("regexp_extract(trim(reply), '\\*\\*([A-Z])\\*\\*', 1)")


@query(f"WITH {S_REPLIES} SELECT conv_id, turn, coalesce({S_STRICT[0]}, {S_BOLD_FIRST}, {S_LONE}, 'A') AS answer FROM r")
def extract_two_step(spark, d):
    found, opts = replies(spark, d)
    return found.select("conv_id", "turn", r.extract_two_step(F.col("reply"), opts).alias("answer"))


@query(f"WITH {S_OPTIONS}, {S_REFUSAL} SELECT qid, coalesce({s_key(s_any('trim(lower(o))', w.OLD_REFUSALS))}, {s_key(s_any('trim(lower(o))', w.OLD_NO_INFO))}) AS refusal_key FROM r")
def refusal_first_old(spark, d):
    return refusal_questions(spark, d).select("qid", r.refusal_key_old(F.col("options")).alias("refusal_key"))


@query(f"""SELECT conv_id, turn, CASE WHEN {s_any('l', w.OLD_DIRTY)} THEN 'BLOCKED-REGEX-DIRTY' WHEN {s_match('l', w.OLD_BAD_INTENT)} THEN 'BLOCKED-REGEX-INTENT' ELSE 'REGEX-FALLBACK' END AS tag FROM (SELECT *, lower(q) AS l FROM ({S_PHRASED}))""")
def route_rules_old(spark, d):
    route = r.route_rules_old(F.col("q"), r.options(F.array(F.lit("yes"), F.lit("no"))))
    return phrased(spark, d).select("conv_id", "turn", route["tag"].alias("tag"))


@query(f"SELECT doc_id, length(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 5 AND NOT {s_any('lower(x)', w.GARBAGE_LINES)}), chr(10))) AS n FROM documents")
def keep_lines(spark, d):
    return texts(spark, d).select("doc_id", F.length(t.keep_lines(F.col("text"))).alias("n"))


@query("SELECT source AS category, doc_id // 20 + 1 AS page, n_chars % 3 AS n_new FROM documents WHERE doc_id // 20 + 1 <= 70 AND doc_id // 20 <= coalesce((SELECT min(d2.doc_id // 20) FROM documents d2 WHERE d2.source = documents.source AND d2.doc_id >= 40 AND d2.n_chars % 3 = 0 AND (SELECT max(d3.n_chars % 3) FROM documents d3 WHERE d3.source = d2.source AND d3.doc_id // 20 IN (d2.doc_id // 20 - 1, d2.doc_id // 20 - 2)) = 0), 1000000)")
def paged_until_empty(spark, d):
    listing = tbl(spark, d, "documents").select(F.col("source").alias("category"), F.expr("doc_id div 20 + 1").alias("page"), (F.col("n_chars") % 3).alias("n_new"))
    return pages.until_empty(listing)


@query()
def vector_index(spark, d):
    """Points of the chunks that are not indexed yet: ids and payload."""
    chunks = chunking.chunk_articles(from_documents(tbl(spark, d, "documents")), "sub")
    indexed = retrieval.vector_points(chunks.filter("chunk_index = 1"), HashedEmbedder())
    points, _ = retrieval.index_new(chunks, indexed, HashedEmbedder())
    return points.select("id", F.size("vector").alias("dimensions"), t.uuid5_namespace(F.col("id"), F.col("payload.chunk_id")).alias("namespace"))


# --- pages

HREF = r'<a\s[^>]*href="([^"#]+)'
S_LINKS = f"""a AS (SELECT url, unnest(regexp_extract_all(html, {s_lit(HREF)}, 1)) AS href FROM pages),
l AS (SELECT DISTINCT url, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href
 WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || href END AS link FROM a WHERE NOT regexp_matches(href, '^(?:javascript|mailto):'))"""


@query(f"WITH {S_LINKS} SELECT url, link FROM l")
def page_links(spark, d):
    return pages.links(tbl(spark, d, "pages"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS src, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS dst FROM pages),
e2 AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
b AS (SELECT src AS node, 0 AS level, src AS origin FROM (SELECT min(src) AS src FROM e) UNION SELECT dst, level + 1, origin FROM b JOIN e2 ON node = src WHERE level < 2)
SELECT node, min(level) AS level, min(origin) AS origin FROM b GROUP BY node""")
def link_bfs2(spark, d):
    url = tbl(spark, d, "pages")
    edges = url.select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("src"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1).alias("dst")).distinct()
    both = edges.union(edges.select("dst", "src")).distinct()
    return pages.traverse(edges.agg(F.min("src").alias("node")), both, 2)


# lines of the article: block tags end them, other tags go, entities are read, white space is one space
S_LINES = """x AS (SELECT page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_split_to_array(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(?:h1|p|br)>') AS parts FROM pages),
y AS (SELECT *, list_filter(list_transform(parts, lambda l: trim(regexp_replace(replace(replace(regexp_replace(l, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))), lambda l: l <> '') AS lines,
length(trim(regexp_replace(replace(replace(title, '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS title_chars FROM x)"""


def content_rows(pages_: DataFrame, least: int = 200):
    found = pages_.select("page_id", pages.main_content(F.col("html"), least).alias("m"))
    return found.select("page_id", F.length("m.title").alias("title_chars"), "m.n_blocks", F.sha2("m.text", 256).alias("text"))


@query(f"WITH {S_LINES} SELECT page_id, title_chars, CAST(len(lines) AS INT) AS n_blocks, sha256(array_to_string(lines, chr(10))) AS text FROM y")
def main_content(spark, d):
    """Title and content of pages [K14, K15]."""
    return content_rows(tbl(spark, d, "pages"))


#: What stands around and inside an article in a page's layout, and is no content.
BAR = '<div><span>Share</span><span>Like</span><span>Pin</span><span>Send</span></div>'
BESIDE = '<section><h4>More</h4><ul>' + "".join(f'<li><a href="/m{i}">Another page that is worth the reading, number {i}</a>' for i in range(5)) + "</ul><p>Also new</p></section>"
SHORT = "<h2>In short</h2><ul><li>first point<li>second point</ul>"


@query(f"WITH {S_LINES} SELECT page_id, title_chars, CAST(len(lines) + 3 AS INT) AS n_blocks, sha256(array_to_string(lines || ['In short', 'first point', 'second point'], chr(10))) AS text FROM y")
def content_in_layout(spark, d):
    """Content of pages whose article stands in columns among lists of links, and holds a bar of buttons, a list of links, and a short list that stays [K14]."""
    inner = F.replace(F.replace("html", F.lit("</article>"), F.lit(f"{SHORT}{BESIDE}</article></div>{BESIDE}</div>")), F.lit("<article>"), F.lit(f"<div><div>{BESIDE}</div><div>{BAR}<article>{BAR}"))
    return content_rows(tbl(spark, d, "pages").withColumn("html", inner), 1)


@query()
def boilerplate_free(spark, d):
    return tbl(spark, d, "pages").select("page_id", F.sha2(pages.boilerplate_free(F.col("html")), 256).alias("text"))


@query("SELECT page_id, md5(url) AS url_hash, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_titles(spark, d):
    return tbl(spark, d, "pages").select("page_id", F.md5("url").alias("url_hash"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


# --- chunking


S_FOOTER = f"length(trim(l)) < 50 AND (starts_with(trim(l), '=') OR starts_with(trim(l), '#') OR l = upper(l)) AND list_contains([{', '.join(map(s_lit, w.FOOTER_STEM))}], trim(lower(trim(l)), '=#-:. '))"
S_KIND = r"CASE WHEN starts_with(l, '|') THEN 't' WHEN regexp_matches(l, '^(?:[\-*•]|\d+\.)\s') THEN 'l' WHEN regexp_matches(l, '\$|\\[a-z]+\{|[∑∫√±≠≤≥]') THEN 'f' ELSE 'p' END"
S_STRUCTURED = rf"""a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
b AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda l: {S_FOOTER}), true) AS pos FROM a),
c AS (SELECT doc_id, unnest(k) AS l, generate_subscripts(k, 1) AS i FROM (SELECT doc_id, CASE WHEN pos > 0 THEN list_slice(ls, 1, pos - 1) ELSE ls END AS k FROM b)),
e AS (SELECT doc_id, i, regexp_replace(l, '^\s+|\s+$', '', 'g') AS l FROM c),
f AS (SELECT doc_id, i, l, CASE WHEN l <> '' THEN {S_KIND.replace("l, '", "c, '").replace("(l,", "(c,")} END AS kind, c FROM (SELECT *, regexp_replace(l, '{w.CITATION}', '', 'g') AS c FROM e)),
g AS (SELECT doc_id, i, c AS l, coalesce(kind, last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS kind, kind IS NULL AS blank FROM f),
h AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM g WHERE NOT blank OR (kind IS NOT NULL AND kind <> 'p')),
r AS (SELECT doc_id, run, CASE WHEN kind = 'p' THEN string_agg(l, chr(10) || chr(10) ORDER BY i) ELSE string_agg(l, chr(10) ORDER BY i) END AS t FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM h) GROUP BY doc_id, run, kind),
x AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY run) AS t FROM r GROUP BY doc_id)"""


@query(f"WITH {S_STRUCTURED} SELECT doc_id, length(coalesce(t, '')) AS n, sha256(coalesce(t, '')) AS digest FROM documents LEFT JOIN x USING (doc_id)")
def structured_clean(spark, d):
    return chunking.structured_rows(texts(spark, d), "text", ["doc_id"], out="c").select("doc_id", F.length("c").alias("n"), F.sha2("c", 256).alias("digest"))


@query()
def split_general(spark, d):
    return chunking.split_rows(texts(spark, d), "text", ["doc_id"], "general").select("doc_id", "chunk_index", F.length("content").alias("n"))


@query()
def split_legal(spark, d):
    return chunking.split_rows(texts(spark, d), "text", ["doc_id"], "legal_sub").select("doc_id", "chunk_index", F.length("content").alias("n"))


@query()
def statute_parse(spark, d):
    docs = tbl(spark, d, "documents")
    law = F.concat(F.lit("CHƯƠNG I\nQUY ĐỊNH CHUNG\nĐiều 1. "), "text", F.lit("\nĐiều 2. End\nCHƯƠNG II\nĐiều 3. Last\nBody"))
    laws = docs.select("doc_id", law.alias("law"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"))
    return chunking.statute_rows(laws, "law", "title", ["doc_id"]).select("doc_id", "article", F.length("content").alias("n"))


@query(f"""WITH {S_STRUCTURED} SELECT domain, count(*) AS n_docs FROM (SELECT CASE WHEN lang = 'en' THEN 'legal' WHEN lang = 'de' THEN 'own' ELSE 'general' END AS domain
FROM documents JOIN x USING (doc_id) WHERE length(t) >= 100) GROUP BY domain""")
def chunks_by_callback(spark, d):
    """Documents with chunks by the domain that a caller's rule gives their category [K11]; a null one is general."""
    own = lambda category: F.when(category.startswith("en"), "legal").when(category.startswith("de"), "own")
    return chunking.chunk_articles(from_documents(tbl(spark, d, "documents")), domain_of=own).groupBy("domain").agg(F.count_distinct("doc_title").alias("n_docs"))


@query()
def chunk_table(spark, d):
    chunks = chunking.chunk_articles(from_documents(tbl(spark, d, "documents")), "stem")
    return chunks.drop("vector_text", "display_text").withColumn("id", t.uuid5(F.col("chunk_id")))


@query()
def chunk_table_wiki(spark, d):
    return chunking.chunk_articles(from_documents(tbl(spark, d, "documents")), "wiki").select("chunk_id", "chunk_index", "char_count", "word_count")


@query()
def answer_batch(spark, d):
    chunks = stored(answered_from(chunking.chunk_articles(from_documents(tbl(spark, d, "documents")), "sub")))  # read by both legs and the prompts
    questions = option_questions(spark, d).select(F.col("qid").cast("string").alias("qid"), "question", "choices")
    points = embed(chunks.select("chunk_id", "vector_text"), HashedEmbedder(), "vector_text").select("chunk_id", "vector")
    vectors = embed(questions.select("qid", "question"), HashedEmbedder(), "question").select("qid", "vector")
    return answer(questions, chunks, points, vectors, OfflineChat(), OfflineChat())


# --- streams and extensions

S_WINDOWS = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


@query(S_WINDOWS)
def event_windows(spark, d):
    return jobs.window_counts(tbl(spark, d, "events"))


@query(S_WINDOWS)
def stream_event_windows(spark, d):
    """The same windows from a stream over the file, run to its end."""
    folder = work_folder(spark, "stream")
    counted = jobs.table_source(spark, f"{d}/events.parquet", jobs.EVENTS).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    rows = counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")

    def write(batch: DataFrame, number: int) -> None:  # complete mode: the last batch has all windows
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    run = rows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_windows(spark, d):
    return jobs.sessions(tbl(spark, d, "events"))


@query("""SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def joins_ext(spark, d):
    asia = tbl(spark, d, "nation").join(tbl(spark, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    asian = tbl(spark, d, "customer").join(F.broadcast(asia), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")  # nations are a fixed few
    return tbl(spark, d, "orders").join(asian, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_ext(spark, d):
    return tbl(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 4) AS k FROM events GROUP BY event_type")
def event_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return tbl(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg(k), 4).alias("k"))
