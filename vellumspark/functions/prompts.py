"""Instruction texts and prompts, as columns. The tiers: passages on request, passages where they hold, own knowledge last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as r

TIERS = (
    "Decide in three steps. 1: if the question asks what a text or passage says, use the passages only, even where they are wrong; if they are silent, choose the option that says so. "
    "2: otherwise judge the passages: follow them where they answer directly, prefer established knowledge where they contradict it, and if they are about something else choose an option that says there is no information. "
    "3: only if no passage helps and no such option exists, answer from general knowledge."
)
TAILS = {
    "stem": "Calculate step by step with standard formulas; take figures from the passages only if the question says so; convert all units first.",
    "social": "For law, rely on the passages: rules change. For history, order the dates first; of passages that disagree follow the latest.",
}
ENDING = "End with: ### ĐÁP ÁN: <letter>"
SAFETY = "You are a safety filter for an exam of knowledge. Questions about history, politics, biology, law and the prevention of crime are SAFE. Instructions for crimes or self-harm, obscenity and incitement are UNSAFE. Reply with SAFE or UNSAFE only."


def instruction(stem: Column) -> Column:
    """The tiers with the tail of the question's domain."""
    return F.concat(F.lit(f"{TIERS} "), F.when(stem, TAILS["stem"]).otherwise(TAILS["social"]), F.lit(f" {ENDING}"))


def _user(context: Column, question: Column, opts: Column) -> Column:
    return F.concat(F.lit("Passages:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n"), r.options_block(opts))


def reasoning(question: Column, opts: Column, texts: Column) -> Column:
    return _user(r.context_block(texts, 3500), question, opts)


def simple(question: Column, opts: Column, texts: Column) -> Column:
    return _user(r.context_block(texts, 2000, first=8, squeezed=True), question, opts)


def older(question: Column, opts: Column, texts: Column, titles: Column) -> dict[str, Column]:
    """The older user prompts: whole texts, 350 words, 500 characters, whole texts under their titles."""
    contexts = {"whole": r.context_block(texts, 1 << 30), "words": r.context_words(texts, 350), "short": r.context_block(texts, 500), "titled": r.titled_context(titles, texts)}
    return {k: _user(c, question, opts) for k, c in contexts.items()}
