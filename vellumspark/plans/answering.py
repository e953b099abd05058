"""Question batches end to end: route, retrieve, prompt, ask, extract, check, fall back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import rules as r
from ..functions.replies import verdict
from ..functions.text import nfc, nfc_all
from ..operators.retrieval import bm25_search, dense_search, fuse_ranks, with_payload
from ..providers import FallbackChat, ask
from ..settings import Settings
from ..storage import cut

ROUTER_PROMPT = "Classify the question. Reply with one JSON object with the keys safety (SAFE or UNSAFE), domain (STEM, LEGAL or SOCIAL) and refusal_status (NO_INFO_VALID, TRAP_IGNORED, SAFETY_REFUSAL or NONE)."


def lettered(questions: DataFrame) -> DataFrame:
    """qid, question, options (lettered), from choices or options, with composed characters: the rules match no others."""
    choices = F.col("choices") if "choices" in questions.columns else F.col("options")
    composed = questions.select(F.col("qid").cast("string").alias("qid"), nfc(F.col("question")).alias("question"), nfc_all(choices).alias("choices"))
    return composed.select("qid", "question", r.options(F.col("choices")).alias("options"))


def route(questions: DataFrame, chat, **how) -> DataFrame:
    """questions with a route struct; an unreadable reply takes the rules, an empty one may block."""
    user = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n"), r.options_block(F.col("options")))
    asked = ask(questions.withColumn("system", F.lit(ROUTER_PROMPT)).withColumn("user", user), chat, "system", "user", "router_reply", **how).drop("system", "user")
    told = verdict(F.col("router_reply"))
    by_model = r.route_model(F.col("question"), F.col("options"), F.col("told.safety"), F.col("told.domain"), F.col("told.refusal_status"))
    silent = (F.coalesce("router_reply", F.lit("")) == "") & r.silent_block(F.col("question"))
    blocked = F.struct(F.lit(True).alias("is_unsafe"), F.lit(False).alias("is_stem"), F.lit(False).alias("use_large"), F.lit("BLOCKED-SILENT-BLOCK").alias("tag"), r.blocked_key(F.col("options")).alias("refusal_key"), F.lit("SAFETY").alias("refusal_type"))
    routed = F.when(silent, blocked).when(F.col("told").isNotNull(), by_model).otherwise(r.route_rules(F.col("question"), F.col("options")))
    return asked.withColumn("told", told).withColumn("route", routed).drop("told", "router_reply")


def retrieve(questions: DataFrame, chunks: DataFrame, points: DataFrame, vectors: DataFrame, settings: Settings) -> DataFrame:
    """Fused hits of the questions that are not blocked: k for stem questions or others, by route."""
    open_ = questions.filter(~F.col("route.is_unsafe"))
    k = max(settings.k_stem, settings.k_other)
    sparse = bm25_search(chunks, open_, 2 * k, text_col="vector_text", k1=settings.k1, b=settings.b)
    dense = dense_search(points, vectors, k, "chunk_id", "vector")
    sparse, dense = cut(sparse), cut(dense)  # few rows each, used more than once by the fusion
    fused = fuse_ranks(sparse, dense, k, settings.alpha, settings.rrf_constant, compat=True)
    most = F.when(F.col("route.is_stem"), settings.k_stem).otherwise(settings.k_other)
    return fused.join(open_.select("qid", most.alias("k")), "qid").filter(F.col("rank") <= F.col("k")).drop("k")


def contexts(hits: DataFrame, chunks: DataFrame, settings: Settings, questions: int) -> DataFrame:
    """(qid, passages) in rank order; over most_context characters only five passages of 2,000 stay."""
    found = with_payload(hits, chunks, "chunk_id", ["display_text"], questions * max(settings.k_stem, settings.k_other))
    listed = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "display_text"))), lambda x: x["display_text"]).alias("passages"))
    size = F.aggregate("passages", F.lit(0), lambda n, x: n + F.length(x))
    return listed.withColumn("passages", F.when(size > settings.most_context, F.transform(F.slice("passages", 1, 5), lambda x: F.substring(x, 1, 2000))).otherwise(F.col("passages")))


def _final(reply: Column, use_hint: bool) -> Column:
    """The reply's letter after the checks (a hint of the router where the reply is unsure, none that contradicts the options), else a heuristic."""
    letter = r.checked_answer(reply, r.extract_answer(reply, F.col("options")), F.col("options"), F.col("route.refusal_key"), F.col("route.refusal_type"), use_hint)
    heuristic = F.when(F.col("route.is_stem"), r.math_answer(F.col("question"), F.col("options"))).otherwise(r.overlap_answer(F.col("question"), F.col("options")))
    return F.coalesce(letter, heuristic, F.lit("A"))


def ask_by_size(df: DataFrame, large, small, system: str, user: str, out: str, **how) -> DataFrame:
    """df with the reply of the model that its route asks for; the other model answers what that one leaves empty."""
    big = F.col("route.use_large")
    return ask(df.filter(big), FallbackChat(large, small), system, user, out, **how).unionByName(ask(df.filter(~big), FallbackChat(small, large), system, user, out, **how))


FORCE_PROMPT = "Use your own knowledge to choose the best letter. No explanation. End with: ### ĐÁP ÁN: <letter>"


def again(replied: DataFrame, chat, small=None, **how) -> DataFrame:
    """Second pass over replies that say they do not know: the option that says so answers, else the model is asked without passages."""
    unsure = r.refusal_reply(F.col("reply"))
    kept = cut(replied.withColumn("unsure", F.coalesce(unsure, F.lit(False))))  # a paid reply is used more than once below
    sure = kept.filter(~F.col("unsure"))
    option = r.no_info_key(F.col("options"))
    chosen = kept.filter(F.col("unsure") & option.isNotNull()).withColumn("reply", F.concat(F.lit("### ĐÁP ÁN: "), option))
    user = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n"), r.options_block(F.col("options")))
    open_ = kept.filter(F.col("unsure") & option.isNull()).drop("reply").withColumns({"system": F.lit(FORCE_PROMPT), "user": user})
    return sure.unionByName(chosen).unionByName(ask_by_size(open_, chat, small or chat, "system", "user", "reply", **how)).drop("unsure")


def answered_from(chunks: DataFrame) -> DataFrame:
    """The columns of a chunk table that answers need: what they leave out is not computed."""
    return chunks.select("chunk_id", "vector_text", "display_text")


def counters(answers: DataFrame) -> DataFrame:
    """Answers by route tag and status."""
    return answers.groupBy("tag", "status").agg(F.count(F.lit(1)).alias("n"))


def answer(questions: DataFrame, chunks: DataFrame, points: DataFrame, vectors: DataFrame, router, chat, settings: Settings | None = None, small=None, at_once: int = 1, bucket=None, use_hint: bool = True) -> DataFrame:
    """(qid, answer, tag, status, model) for every question.

    The route chooses the model: ``chat`` is the large one, ``small`` the other
    (the same if none is given); each answers what the other leaves empty.  At most
    ``at_once`` calls of a task are open, ``bucket`` limits their rate.  use_hint: an
    unsure reply gives way to the option that the router found to say that there is
    no information.
    """
    settings, small, how = settings or Settings(), small or chat, {"at_once": at_once, "bucket": bucket}
    routed = cut(route(lettered(questions), router, **how))  # paid replies
    found = contexts(retrieve(routed, chunks, points, vectors, settings), chunks, settings, routed.count())
    ready = routed.join(found, "qid", "left").withColumn("passages", F.coalesce("passages", F.array().cast("array<string>")))
    stem, large = F.col("route.is_stem"), F.col("route.use_large")
    texts = (F.col("question"), F.col("options"), F.col("passages"))
    asked = ready.filter(~F.col("route.is_unsafe")).withColumn("system", prompts.instruction(stem)).withColumn("user", F.when(stem | large, prompts.reasoning(*texts)).otherwise(prompts.simple(*texts)))
    asked = cut(asked.select("qid", "question", "options", "route", "system", "user"))
    replied = again(ask_by_size(asked, chat, small, "system", "user", "reply", **how), chat, small, **how)
    model = F.when(large, "large").otherwise("small")
    status = F.when(F.coalesce("reply", F.lit("")) == "", "fallback").otherwise("replied")
    answered = replied.select("qid", _final(F.col("reply"), use_hint).alias("answer"), F.col("route.tag").alias("tag"), status.alias("status"), model.alias("model"))
    blocked = routed.filter("route.is_unsafe").select("qid", F.col("route.refusal_key").alias("answer"), F.col("route.tag").alias("tag"), F.lit("blocked").alias("status"), F.lit(None).cast("string").alias("model"))
    return answered.unionByName(blocked)
