"""Sparse and dense retrieval, rank fusion, and their indexes as ordinary tables."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import squeeze, tokens, uuid5
from ..providers import ask, embed
from ..storage import cut, drop_folder, work_folder

#: A query batch of at most this many rows is sent to all tasks; larger ones are joined by shuffle.
MOST_SENT = 200_000


def small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df with a broadcast hint if its row count, checked here, allows it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _score_order(score: str, tie: str) -> list[Column]:
    return [F.col(score).desc(), F.col(tie)]


#: Partitions that a table has at most to be dealt anew: about 1 GB at the reader's default size.
FEW_PARTITIONS = 8


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores; one of more than FEW_PARTITIONS stays as the reader splits it, whatever the cluster. For queries: operators never do this to texts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_PARTITIONS + 1) else df


def top_k(df: DataFrame, k: int, score: str = "score", key: str = "qid", tie: str = "chunk_id", name: str = "rank") -> DataFrame:
    """Rows of rank 1 to k per key, by score then tie."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*_score_order(score, tie)))).filter(F.col(name) <= k)


# --- BM25


def doc_tokens(chunks: DataFrame, id_col: str, text_col: str, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    return chunks.select(F.col(id_col).alias("chunk_id"), tokenizer(F.col(text_col)).alias("tokens")).withColumn("dl", F.size("tokens"))


def build_bm25(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "vector_text", tokenizer: Callable[[Column], Column] = tokens) -> dict[str, DataFrame]:
    """The index tables: postings(term, chunk_id, tf, dl), doc_stats, term_stats, corpus_stats (one row).

    counted has the postings of each row by itself, and its length under a null
    term: one pass over the texts gives all that ``save_index`` needs.
    """
    docs = doc_tokens(chunks, id_col, text_col, tokenizer)
    counted = docs.select("chunk_id", "tokens").mapInArrow(_doc_terms, f"chunk_id {dict(docs.dtypes)['chunk_id']}, dl int, term string, tf bigint")
    postings = _merged(counted.filter("term IS NOT NULL"))
    return {
        "postings": postings,
        "doc_stats": docs.select("chunk_id", "dl"),
        "term_stats": postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")),
        "corpus_stats": _corpus(docs),
        "counted": counted,
    }


def _merged(counted: DataFrame) -> DataFrame:
    """Rows of one id and length are one document."""
    return counted.groupBy("term", "chunk_id", "dl").agg(F.sum("tf").alias("tf"))


def _corpus(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def _doc_terms(batches: Iterator[pa.RecordBatch], at_once: int = 300_000) -> Iterator[pa.RecordBatch]:
    """(chunk_id, dl, term, tf) of each row, and one row with its length and no term; about ``at_once`` tokens at a time."""
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        steps = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // at_once)) + 1
        for begin, end in itertools.pairwise([0, *steps.tolist(), batch.num_rows]):
            ids, dl = batch.column("chunk_id").slice(begin, end - begin), lengths[begin:end]
            coded = batch.column("tokens").slice(begin, end - begin).flatten().dictionary_encode()
            words = max(len(coded.dictionary), 1)
            keys, tf = np.unique(np.repeat(np.arange(end - begin), dl) * words + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            doc = np.append(keys // words, np.arange(end - begin))
            term = pa.concat_arrays([coded.dictionary.take(pa.array(keys % words)), pa.nulls(end - begin, coded.dictionary.type)])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(dl[doc].astype(np.int32)), term, pa.array(np.append(tf, np.zeros(end - begin, np.int64)))], ["chunk_id", "dl", "term", "tf"])


INDEX_TABLES = ("postings", "blocks", "doc_stats", "term_stats", "corpus_stats", "metadata")
#: Blocks of a term's postings at most: bands of the part of the score that lies in (0, 1).
BANDS = 16
#: Partitions over which the postings of a term are dealt, so that those of a stop word are no task's alone.
SALTS = 16
#: Scores are rounded to six places, so bounds are compared with a little to spare.
SLACK = 2e-6


def _saturation(k1: float, b: float, avgdl: float) -> Column:
    return F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))


def save_index(index: dict[str, DataFrame], path: str, k1: float = 1.5, b: float = 0.75) -> None:
    """The index tables and a metadata row. chunk_id stands in the tables themselves: there is no separate id map.

    Postings of a term stand in SALTS partitions at most, its blocks one after the
    other; a block holds the postings of a term that score alike, and ``blocks`` how many they are and the most that they can add.
    The texts are read once: what they count to is kept until the postings are written.
    """
    spark = next(iter(index.values())).sparkSession
    folder = work_folder(spark, "counted")
    index["counted"].write.parquet(folder)
    counted = spark.read.schema(index["counted"].schema).parquet(folder)
    counted.filter("term IS NULL").select("chunk_id", "dl").write.mode("overwrite").parquet(f"{path}/doc_stats")
    docs = spark.read.parquet(f"{path}/doc_stats")
    _corpus(docs).write.mode("overwrite").parquet(f"{path}/corpus_stats")
    stats = spark.read.parquet(f"{path}/corpus_stats").first()
    postings = counted.filter("term IS NOT NULL")
    if docs.groupBy("chunk_id", "dl").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        postings = _merged(postings)
    weighed = postings.withColumn("weight", _saturation(k1, b, stats["avgdl"])).withColumn("block", F.floor(F.col("weight") * BANDS).cast("int"))
    dealt = weighed.repartition("term", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)))
    place = F.shiftleft(F.xxhash64("term"), 5).bitwiseOR(F.col("block"))  # one number: sorted without a look at the words
    dealt.sortWithinPartitions(place).write.mode("overwrite").parquet(f"{path}/postings")
    drop_folder(spark, folder)
    saved = spark.read.parquet(f"{path}/postings")
    saved.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("cf"), F.max("weight").alias("most")).write.mode("overwrite").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), F.max("most").alias("most")).write.mode("overwrite").parquet(f"{path}/term_stats")
    terms = spark.read.parquet(f"{path}/term_stats").count()
    row = (stats["n_docs"], stats["avgdl"], terms, "lucene", k1, b)
    spark.createDataFrame([row], "n_docs long, avgdl double, n_terms long, method string, k1 double, b double").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in INDEX_TABLES}


#: How many times each posting is used on average from which on a batch is scored document by document.
SHARED = 4


def index_search(index: dict[str, DataFrame], questions: DataFrame, k: int, qid_col: str = "qid", question_col: str = "question", tokenizer: Callable[[Column], Column] = tokens, most_terms: int = MOST_SENT) -> DataFrame:
    """``bm25_search`` over a saved index, with the parameters it was saved with: nothing is tokenised again. The result is exact.

    Few questions: the blocks that can add most give each question a score that its
    k-th document reaches at least.  Terms that even together stay below it bring no
    document in; of the others only blocks are read that can still lead over it, and
    documents that cannot are dropped.  What is left gets its other terms by a
    look-up.

    A batch whose questions share their terms (SHARED) would repeat each posting for
    all of them: there each posting of an asked term goes to its document once, and
    a task keeps the best k of each question over the documents that it gets.
    """
    asked = asked_terms(questions, qid_col, question_col, tokenizer)
    known = F.broadcast(asked.select("term").distinct()) if asked.count() <= most_terms else asked.select("term").distinct()
    used = asked.join(index["term_stats"].join(known, "term", "left_semi").select("term", "df"), "term").groupBy("term").agg(F.first("df").alias("df"), F.count(F.lit(1)).alias("n"))
    once, all_ = used.agg(F.sum("df"), F.sum(F.col("df") * F.col("n"))).first()
    if (all_ or 0) >= SHARED * (once or 1):
        return _score_batch(index, asked, k, most_terms)
    wide, lookups = candidates(index, questions, k, qid_col, question_col, tokenizer)
    scored = wide.unionByName(lookups).groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_k(scored.filter("score > 0"), k)


def _score_batch(index: dict[str, DataFrame], asked: DataFrame, k: int, most_terms: int) -> DataFrame:
    """All questions' best k from the postings of their terms, which are dealt by document; over ``most_terms`` the questions are taken in blocks."""
    n_docs = index["metadata"].first()["n_docs"]
    blocks = max(1, -(-asked.count() // most_terms))
    parts = [asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) for i in range(blocks)]
    return top_k(functools.reduce(DataFrame.unionByName, [_postings_block(index, part, n_docs, k) for part in parts]), k)


def _postings_block(index: dict[str, DataFrame], asked: DataFrame, n_docs: int, k: int) -> DataFrame:
    spark, postings = asked.sparkSession, index["postings"]
    schema = f"qid {dict(asked.dtypes)['qid']}, chunk_id {dict(postings.dtypes)['chunk_id']}, score double"
    share = F.col("qtf") * idf(F.lit(n_docs), F.col("df"))
    rows = sorted(F.broadcast(asked).join(index["term_stats"], "term").select("qid", "term", share.alias("share")).collect(), key=lambda r: r["term"])  # most_terms rows, but for one question's
    if not rows:
        return spark.createDataFrame([], schema)
    terms, at = np.unique(np.array([r["term"] for r in rows], object), return_inverse=True)
    qids = list(dict.fromkeys(r["qid"] for r in rows))
    number = {q: i for i, q in enumerate(qids)}
    query, shares = np.array([number[r["qid"]] for r in rows]), np.array([r["share"] for r in rows], np.float64)
    first = np.searchsorted(at, np.arange(len(terms) + 1))  # rows are in the order of their terms
    numbered = spark.createDataFrame([(t, i) for i, t in enumerate(terms.tolist())], "term string, at int")
    dealt = postings.join(F.broadcast(numbered), "term").select("chunk_id", "at", "weight").repartition("chunk_id").sortWithinPartitions("chunk_id")
    return dealt.mapInArrow(_score_dealt(qids, to_arrow_type(asked.schema["qid"].dataType), first, query, shares, k), schema)


def _score_dealt(qids: list, key: pa.DataType, first: np.ndarray, query: np.ndarray, shares: np.ndarray, k: int, rows_held: int = 100_000, at_once: int = 2_000_000):
    """Per task: the best k of each question over postings that come document by document; a step holds about ``at_once`` partial scores."""

    def score(best: Best, held: pa.Table) -> None:
        coded = held.column("chunk_id").combine_chunks().dictionary_encode("encode")
        ids, doc = np.array(coded.dictionary.to_pylist(), object), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        term, weight = held.column("at").to_numpy(), held.column("weight").to_numpy()
        many = first[term + 1] - first[term]
        cost = np.cumsum(np.bincount(doc, many, len(ids)) + len(qids))
        steps = np.flatnonzero(np.diff((cost - cost[0]) // at_once)) + 1
        for begin, end in itertools.pairwise([0, *steps.tolist(), len(ids)]):
            a, b = np.searchsorted(doc, [begin, end])
            n = many[a:b]
            entry = np.arange(n.sum()) + np.repeat(first[term[a:b]] - np.cumsum(n) + n, n)
            place = query[entry] * (end - begin) + np.repeat(doc[a:b] - begin, n)
            scores = np.bincount(place, shares[entry] * np.repeat(weight[a:b], n), len(qids) * (end - begin))
            best.add(np.round(scores, 6).reshape(len(qids), end - begin), ids[begin:end], 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind, held = Best(len(qids), k), None, []
        for batch in batches:
            kind = batch.schema.field("chunk_id").type
            held.append(batch)
            if sum(x.num_rows for x in held) >= rows_held:
                table = pa.Table.from_batches(held)
                same = pc.is_in(table.column("chunk_id"), value_set=table.column("chunk_id").slice(table.num_rows - 1).combine_chunks())
                whole = table.num_rows - pc.sum(same).as_py()  # the last document may go on in the next batch
                if whole:
                    score(best, table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held and kind is not None:
            score(best, pa.Table.from_batches(held))
        yield from best.batches(qids, kind, key)

    return run


def candidates(index: dict[str, DataFrame], questions: DataFrame, k: int, qid_col: str = "qid", question_col: str = "question", tokenizer: Callable[[Column], Column] = tokens) -> tuple[DataFrame, DataFrame]:
    """(qid, chunk_id, part): parts of scores from the terms that can decide, for the documents that may be among the k best; and the parts of their other terms."""
    told = index["metadata"].first()
    asked = asked_terms(questions, qid_col, question_col, tokenizer)
    share = F.col("qtf") * idf(F.lit(told["n_docs"]), F.col("df"))
    terms = cut(small(asked).join(index["term_stats"], "term").select("qid", "term", share.alias("share"), (share * F.col("most")).alias("bound")))
    blocks = cut(small(terms).join(index["blocks"], "term").select("qid", "term", "block", "n", "share", "bound", (F.col("share") * F.col("most")).alias("most")))
    read = lambda wanted: index["postings"].join(small(wanted), ["term", "block"]).select("qid", "chunk_id", (F.col("share") * F.col("weight")).alias("part"))
    # what the k-th best has at least: from each question's best blocks, as many as hold some k documents each
    best = Window.partitionBy("qid").orderBy(F.desc("most"), "term", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.withColumn("before", F.coalesce(F.sum("n").over(best), F.lit(0))).filter(F.col("before") < 4 * k)
    begun = read(first).groupBy("qid", "chunk_id").agg(F.sum("part").alias("part"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("part")))
    least = begun.withColumn("place", place).filter(F.col("place") == k).select("qid", F.col("part").alias("least"))
    # terms from the weakest on, as long as they stay below it together, bring nothing in
    weak = Window.partitionBy("qid").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = terms.groupBy("qid").agg(F.sum("bound").alias("all"))
    split = terms.withColumn("up_to", F.sum("bound").over(weak)).join(least, "qid", "left").join(every, "qid")
    split = cut(split.select("qid", "term", "share", "bound", "all", F.coalesce("least", F.lit(0.0)).alias("least"), (F.col("up_to") < F.coalesce("least", F.lit(0.0)) - SLACK).alias("weak")))
    strong = blocks.select("qid", "term", "block", "share", "most").join(split.filter("NOT weak").select("qid", "term", "bound", "all", "least"), ["qid", "term"])
    strong = strong.filter(F.col("all") - F.col("bound") + F.col("most") >= F.col("least") - SLACK)
    others = split.groupBy("qid").agg(F.sum(F.when(F.col("weak"), F.col("bound")).otherwise(0.0)).alias("rest"), F.max("least").alias("least"))
    found = read(strong).groupBy("qid", "chunk_id").agg(F.sum("part").alias("part"))
    found = cut(found.join(small(others), "qid").filter(F.col("part") + F.col("rest") >= F.col("least") - SLACK).select("qid", "chunk_id", "part"))
    wanted = found.select("qid", "chunk_id").join(small(split.filter("weak").select("qid", "term", "share")), "qid")
    weak_terms = F.broadcast(split.filter("weak").select("term").distinct())
    lookups = index["postings"].join(weak_terms, "term", "left_semi").join(small(wanted), ["term", "chunk_id"]).select("qid", "chunk_id", (F.col("share") * F.col("weight")).alias("part"))
    return found, lookups


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def asked_terms(questions: DataFrame, qid_col: str, question_col: str, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    return questions.select(F.col(qid_col).alias("qid"), F.explode(tokenizer(F.col(question_col))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_search(chunks: DataFrame, questions: DataFrame, k: int, id_col: str = "chunk_id", text_col: str = "vector_text", qid_col: str = "qid", question_col: str = "question", k1: float = 1.5, b: float = 0.75, most_terms: int = MOST_SENT, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """(qid, chunk_id, score, rank): Lucene's BM25 without the (k1 + 1) factor; positive scores, k at most.

    The corpus is read twice and never shuffled: one pass counts the terms that are
    asked for, one scores.  A task keeps the best k of each question, so what is
    shuffled is k rows a question and task.  The batch's terms go to all tasks;
    over ``most_terms`` of them the questions are taken in blocks.
    """
    asked = asked_terms(questions, qid_col, question_col, tokenizer)
    n = asked.count()
    blocks = max(1, -(-n // most_terms))
    parts = [asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) for i in range(blocks)]
    docs = doc_tokens(chunks, id_col, text_col, tokenizer).select("chunk_id", "tokens")
    return top_k(functools.reduce(DataFrame.unionByName, [_bm25_block(docs, part, k, k1, b) for part in parts]), k)


def _bm25_block(docs: DataFrame, asked: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    schema = f"qid {dict(asked.dtypes)['qid']}, chunk_id {dict(docs.dtypes)['chunk_id']}, score double"
    rows = sorted(asked.collect(), key=lambda r: r["term"])  # most_terms rows, but for one question's
    if not rows:
        return docs.sparkSession.createDataFrame([], schema)
    terms, at = np.unique(np.array([r["term"] for r in rows], object), return_inverse=True)
    counted = docs.select("tokens").mapInArrow(_count_terms(terms.tolist()), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in counted}
    n_docs, length = found.pop(-1, 0), found.pop(-2, 0)
    df = np.array([found.get(i, 0) for i in range(len(terms))], np.float64)
    qids = list(dict.fromkeys(r["qid"] for r in rows))
    number = {q: i for i, q in enumerate(qids)}
    weights = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))[at] * np.array([r["qtf"] for r in rows], np.float64)
    query = np.array([number[r["qid"]] for r in rows])
    first = np.searchsorted(at, np.arange(len(terms) + 1))  # rows are in the order of their terms
    score = _score_terms(terms.tolist(), qids, to_arrow_type(asked.schema["qid"].dataType), first, query, weights, k, k1, b, length / n_docs if length else 1.0)
    return docs.mapInArrow(score, schema)


def _term_pairs(column: pa.Array, known: pa.Array, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf) of the known terms in a column of token lists, and the lists' lengths."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.fill_null(pc.index_in(column.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    keys, tf = np.unique((np.repeat(np.arange(len(lengths)), lengths) * terms + at)[at >= 0], return_counts=True)
    return keys // terms, keys % terms, tf, lengths


def _count_terms(terms: list[str]):
    """Per task: the number of documents with each term; as term -1 that of all documents, as -2 of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, n, length = pa.array(terms, pa.string()), np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            _, term, _, lengths = _term_pairs(batch.column("tokens"), known, len(terms))
            df += np.bincount(term, minlength=len(terms))
            n, length = n + len(lengths), length + int(lengths.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2]).astype(np.int32)), pa.array(np.append(df[some], [n, length]))], ["term", "n"])

    return run


def _score_terms(terms: list[str], qids: list, key: pa.DataType, first: np.ndarray, query: np.ndarray, weights: np.ndarray, k: int, k1: float, b: float, avgdl: float):
    at_once = max(1, 2_000_000 // len(query))  # documents, so that a step holds as many partial scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best, kind = pa.array(terms, pa.string()), Best(len(qids), k), None
        for batch in batches:
            kind = batch.column("chunk_id").type
            ids = np.array(batch.column("chunk_id").to_pylist(), object)
            for a in range(0, batch.num_rows, at_once):
                doc, term, tf, lengths = _term_pairs(batch.column("tokens").slice(a, at_once), known, len(terms))
                weight = tf / (tf + k1 * (1 - b + b * lengths[doc] / avgdl))
                many = first[term + 1] - first[term]
                entry = np.arange(many.sum()) + np.repeat(first[term] - np.cumsum(many) + many, many)
                place = query[entry] * len(lengths) + np.repeat(doc, many)
                scores = np.bincount(place, weights[entry] * np.repeat(weight, many), len(qids) * len(lengths))
                best.add(np.round(scores, 6).reshape(len(qids), len(lengths)), ids[a : a + len(lengths)], 0.0)
        yield from best.batches(qids, kind, key)

    return run


class Best:
    """The k best (score, then smallest id) of each query over any number of blocks of scores."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, object))] * queries

    def add(self, scores: np.ndarray, ids: np.ndarray, above: float = -np.inf, rows: np.ndarray | None = None) -> None:
        """scores: queries (all, or those of the given numbers) by ids; only those over ``above`` count."""
        rows = np.arange(len(scores)) if rows is None else rows
        good = (scores >= self.least[rows, None]) & (scores > above)
        for q in np.flatnonzero(good.any(axis=1)).tolist():
            old, names = self.held[rows[q]]
            new = np.flatnonzero(good[q])
            if len(new) > 4 * self.k:  # all that can be among the best, ties with the last of them included
                new = new[scores[q, new] >= np.partition(scores[q, new], -self.k)[-self.k]]
            score, name = np.concatenate((old, scores[q, new])), np.concatenate((names, ids[new]))
            order = np.array(sorted(range(len(score)), key=lambda i, s=score, n=name: (-s[i], n[i]))[: self.k])
            self.held[rows[q]] = score[order], name[order]
            if len(order) == self.k:
                self.least[rows[q]] = score[order[-1]]

    def batches(self, qids: list, kind: pa.DataType | None, key: pa.DataType, at_once: int = 1000) -> Iterator[pa.RecordBatch]:
        """Rows of (qid, chunk_id, score), the ids in the types of their columns."""
        for a in range(0, len(qids), at_once) if kind is not None else ():
            held = self.held[a : a + at_once]
            names = [x for _, n in held for x in n.tolist()]
            asked = [q for q, (_, n) in zip(qids[a : a + at_once], held, strict=True) for _ in range(len(n))]
            yield pa.RecordBatch.from_arrays([pa.array(asked, key), pa.array(names, kind), pa.array(np.concatenate([s for s, _ in held]))], ["qid", "chunk_id", "score"])


# --- vectors


def dense_search(points: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", qid_col: str = "qid", query_col: str = "vector", most_queries: int = 20_000, block: int = 256) -> DataFrame:
    """(qid, chunk_id, score, rank): exact cosine top k.

    The queries (number checked) go to every task as one matrix, of which ``block``
    rows at a time are multiplied with a batch of points; a task gives k rows for
    each query, so the shuffle is k rows a query and task, never queries times points.
    """
    rows = queries.select(qid_col, query_col).limit(most_queries + 1).collect()
    if len(rows) > most_queries:
        raise ValueError(f"over {most_queries} query vectors: search in blocks")
    rows = [r for r in rows if r[1] is not None]
    ids = [r[0] for r in rows]
    schema = f"qid {dict(queries.dtypes)[qid_col]}, chunk_id {dict(points.dtypes)[id_col]}, score double"
    if not ids:
        return points.sparkSession.createDataFrame([], f"{schema}, rank int")
    q, key = _unit(np.array([r[1] for r in rows], np.float64)), to_arrow_type(queries.schema[qid_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(len(ids), k), None
        for batch in batches:
            vectors = batch.column(1).drop_null()
            if len(vectors):
                kind = batch.column(0).type
                names = np.array(batch.column(0).filter(batch.column(1).is_valid()).to_pylist(), object)
                unit = _unit(matrix(vectors)).T
                for a in range(0, len(ids), block):
                    best.add(np.round(q[a : a + block] @ unit, 6), names, rows=np.arange(a, min(a + block, len(ids))))
        yield from best.batches(ids, kind, key)

    return top_k(points.select(id_col, vector_col).mapInArrow(run, schema), k)


def matrix(vectors: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles; all of one size."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def dense_search_blocks(points: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", qid_col: str = "qid", query_col: str = "vector", block: int = 10_000) -> DataFrame:
    """``dense_search`` for any number of queries: blocks of about ``block`` by a hash of the query id, one search each."""
    blocks = max(1, -(-queries.count() // block))
    parts = [queries.filter(F.pmod(F.xxhash64(qid_col), F.lit(blocks)) == b) for b in range(blocks)]
    return functools.reduce(DataFrame.unionByName, [dense_search(points, q, k, id_col, vector_col, qid_col, query_col) for q in parts])


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def payload() -> Column:
    """What a point carries of its chunk."""
    return F.struct(F.col("doc_title").alias("title"), F.col("display_text").alias("text"), F.col("doc_category").alias("category"), F.col("doc_url").alias("url"), "chunk_id")


def vector_points(chunks: DataFrame, provider) -> DataFrame:
    """The vector table: uuid5 id, vector, payload; a chunk that the provider gives no vector has a null one."""
    embedded = embed(chunks.select("chunk_id", "vector_text", payload().alias("payload")), provider, "vector_text")
    return embedded.select(uuid5(F.col("chunk_id")).alias("id"), "vector", "payload")


def index_new(chunks: DataFrame, indexed: DataFrame, provider) -> tuple[DataFrame, DataFrame]:
    """(points to upsert, dead letters) of the chunks whose id is not indexed yet. Persist or write the points before reading them twice."""
    points = vector_points(chunks.join(indexed.select(F.col("payload.chunk_id").alias("chunk_id")), "chunk_id", "left_anti"), provider)
    return points.filter("vector IS NOT NULL"), points.filter("vector IS NULL").select(F.col("payload.chunk_id").alias("chunk_id"))


# --- fusion


def complete_payload(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Dense hits and the ids that only the sparse leg has, these with score 0."""
    extra = sparse.select("qid", "chunk_id").join(dense.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    return dense.select("qid", "chunk_id", "score").unionByName(extra.withColumn("score", F.lit(0.0)))


def _ranked(hits: DataFrame, name: str) -> DataFrame:
    """Ranks from 0 by score, then id."""
    order = Window.partitionBy("qid").orderBy(*_score_order("score", "chunk_id"))
    return hits.select("qid", "chunk_id", (F.row_number().over(order) - 1).alias(name))


def fuse_ranks(sparse: DataFrame, dense: DataFrame, k: int, alpha: float = 0.5, constant: int = 60, absent: int | None = None, compat: bool = False) -> DataFrame:
    """Reciprocal rank fusion: alpha / (constant + dense rank) + (1 - alpha) / (constant + sparse rank).

    absent: the rank of an id that a leg lacks, None for no contribution.
    compat: ids that only the sparse leg has get a dense rank at score 0.
    """
    dense = complete_payload(sparse, dense) if compat else dense
    both = _ranked(dense, "rv").join(_ranked(sparse, "rb"), ["qid", "chunk_id"], "full_outer")
    part = lambda share, rank: F.coalesce(F.lit(share) / (constant + F.col(rank)), F.lit(0.0 if absent is None else share / (constant + absent)))
    return top_k(both.select("qid", "chunk_id", F.round(part(alpha, "rv") + part(1 - alpha, "rb"), 8).alias("score")), k)


def fuse_max_norm(sparse: DataFrame, dense: DataFrame, k: int, alpha: float = 0.5, least: float = 0.0, share: float | None = None) -> DataFrame:
    """Weighted sum of the legs' scores over their maxima; an absent score counts 0.

    share: keep sparse hits of at least max(least, the score at that share of the list).
    """
    if share is not None:
        place = F.row_number().over(Window.partitionBy("qid").orderBy(*_score_order("score", "chunk_id")))
        at = F.floor(F.count(F.lit(1)).over(Window.partitionBy("qid")) * share).cast("int") + 1
        marked = sparse.withColumn("place", place).withColumn("at", at)
        bound = F.greatest(F.lit(least), F.max(F.when(F.col("place") == F.col("at"), F.col("score"))).over(Window.partitionBy("qid")))
        sparse = marked.withColumn("bound", bound).filter(F.col("score") >= F.col("bound"))
    best = F.max("score").over(Window.partitionBy("qid"))
    norm = lambda hits, name: hits.select("qid", "chunk_id", F.when(best > 0, F.col("score") / best).otherwise(0.0).alias(name))
    both = norm(dense, "v").join(norm(sparse, "s"), ["qid", "chunk_id"], "full_outer")
    score = alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))
    return top_k(both.select("qid", "chunk_id", F.round(score, 8).alias("score")), k)


def with_payload(hits: DataFrame, chunks: DataFrame, id_col: str, columns: list[str], most: int | None = None) -> DataFrame:
    """Late materialisation: texts join after the cut; hits without a payload are dropped.

    most: a known bound on the number of hits (questions times k); under
    MOST_SENT the hits go to the texts.  Without one the hits are counted first.
    """
    if most is None:
        hits = small(hits)
    elif most <= MOST_SENT:
        hits = F.broadcast(hits)
    return chunks.select(F.col(id_col).alias("chunk_id"), *columns).join(hits, "chunk_id")


RERANK_PROMPT = "Name the numbers of the passages that help most to answer the question, best first, separated by commas. Numbers only."


def rerank(hits: DataFrame, questions: DataFrame, chunks: DataFrame, chat, k: int = 8, most: int = 15, preview: int = 300, id_col: str = "chunk_id", text_col: str = "display_text") -> DataFrame:
    """(qid, chunk_id, rank): the first ``most`` hits in the order that a model's reply names, k at most; k hits or fewer stay as they are."""
    found = with_payload(hits.filter(F.col("rank") <= most), chunks, id_col, [text_col])
    listed = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.substring(squeeze(F.col(text_col)), 1, preview).alias("text")))).alias("h"))  # most rows at most
    passages = F.array_join(F.transform("h", lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x["text"])), "\n")
    asked = listed.join(questions.select("qid", "question"), "qid").select("qid", "h", F.lit(RERANK_PROMPT).alias("system"), F.concat(F.lit("Question: "), "question", F.lit("\n"), passages).alias("user"))
    few = F.size("h") <= k
    replied = ask(asked.filter(~few), chat, "system", "user", "reply").select("qid", "h", "reply").unionByName(asked.filter(few).select("qid", "h", F.lit("").alias("reply")))
    order = parse_ranking(F.col("reply"), F.size("h"), k)
    return replied.select("qid", "h", F.posexplode(order).alias("place", "at")).select("qid", F.element_at("h", F.col("at") + 1)["chunk_id"].alias("chunk_id"), (F.col("place") + 1).alias("rank"))


def parse_ranking(reply: Column, n: Column, k: int) -> Column:
    """Positions (from 0) that a reranking reply names, distinct and in range, filled up in order, k at most."""
    named = F.transform(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    named = F.array_distinct(F.filter(named, lambda x: x.isNotNull() & (x >= 0) & (x < n)))
    every = F.sequence(F.lit(0), n - 1)
    return F.when(n <= k, every).otherwise(F.slice(F.concat(named, F.array_except(every, named)), 1, k))
