"""Routing rules, refusal finders, options and answers, as columns.

Options are arrays of structs (key, text) in their order: the first match wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as w
from .text import contains_any, lower, matches_any, squeeze, tokens


def options(choices: Column) -> Column:
    """Choices to lettered options, up to the first that is null, empty or 'nan'."""
    bad = F.transform(choices, lambda c: F.coalesce(c, F.lit("")).isin("", "nan", "NaN"))
    stop = F.array_position(bad, True).cast("int")
    kept = F.when(stop > 0, F.slice(choices, F.lit(1), stop - 1)).otherwise(choices)
    return F.transform(kept, lambda c, i: F.struct(F.chr(i + 65).alias("key"), c.alias("text")))


def _first(matching: Column) -> Column:
    return F.get(matching, F.lit(0))["key"]


def _where(opts: Column, test) -> Column:
    return F.filter(opts, lambda o: test(F.trim(lower(o["text"]))))


# --- questions


def critical(question: Column) -> Column:
    return contains_any(lower(question), w.CRITICAL)


def sensitive(question: Column, hard=w.HARD_BAN, soft=w.SOFT_BAN, allowed=w.WHITELIST) -> Column:
    q = lower(question)
    return F.when(contains_any(q, hard), "SENSITIVE").when(contains_any(q, soft) & ~contains_any(q, allowed), "SUSPICIOUS").otherwise("SAFE")


def academic(question: Column) -> Column:
    return contains_any(lower(question), w.ACADEMIC)


def silent_block(question: Column) -> Column:
    """Whether an empty reply of the routing model blocks the question."""
    return contains_any(lower(question), w.SILENCE_SUSPICIOUS) & ~academic(question)


def _safety_keys(opts: Column) -> Column:
    return _where(opts, lambda t: ~contains_any(t, w.SAFETY_EXCLUSIONS) & matches_any(t, w.SAFETY_PATTERNS))


def _no_info_keys(opts: Column) -> Column:
    return _where(opts, lambda t: ~contains_any(t, w.NO_INFO_SKIP + w.NO_INFO_EXCLUSIONS) & matches_any(t, w.NO_INFO_PATTERNS))


def refusal_key(opts: Column) -> Column:
    """All options are tested for a safety refusal before any for lack of information."""
    return F.coalesce(_first(_safety_keys(opts)), _first(_no_info_keys(opts)))


def refusal_type(opts: Column) -> Column:
    return F.when(_first(_safety_keys(opts)).isNotNull(), "SAFETY").when(_first(_no_info_keys(opts)).isNotNull(), "NO_INFO")


def no_info_key(opts: Column) -> Column:
    return _first(_where(opts, lambda t: ~contains_any(t, w.NO_INFO_WIDE_SKIP + w.NO_INFO_WIDE_EXCLUSIONS) & matches_any(t, w.NO_INFO_WIDE_PATTERNS)))


def blocked_key(opts: Column) -> Column:
    return F.coalesce(refusal_key(opts), _first(_where(opts, lambda t: contains_any(t, w.BLOCK_PHRASES))), F.lit("A"))


def _route(unsafe, stem, large, tag, key, kind) -> Column:
    return F.struct(unsafe.alias("is_unsafe"), stem.alias("is_stem"), large.alias("use_large"), tag.alias("tag"), key.cast("string").alias("refusal_key"), kind.cast("string").alias("refusal_type"))


def route_rules(question: Column, opts: Column) -> Column:
    """The rule router: academic context, then dirty words, then intent, then a mathematics hint."""
    q, no, yes, none = lower(question), F.lit(False), F.lit(True), F.lit(None)
    blocked = lambda tag: _route(yes, no, no, F.lit(f"BLOCKED-{tag}"), blocked_key(opts), F.lit("SAFETY"))
    return (
        F.when(academic(question), _route(no, no, yes, F.lit("REGEX-ACADEMIC"), none, none))
        .when(contains_any(q, w.DIRTY), blocked("REGEX-DIRTY"))
        .when(q.rlike(w.BAD_INTENT), blocked("REGEX-INTENT"))
        .otherwise(_route(no, q.rlike(w.MATH_HINT), yes, F.lit("REGEX-FALLBACK"), none, none))
    )


def route_model(question: Column, opts: Column, safety: Column, domain: Column, status: Column) -> Column:
    """The model router's reply (three words, null if unreadable) to a route; an unreadable one takes the rules."""
    q, no, yes = lower(question), F.lit(False), F.lit(True)
    safety, domain, status = F.upper(F.coalesce(safety, F.lit("SAFE"))), F.upper(F.coalesce(domain, F.lit("SOCIAL"))), F.upper(F.coalesce(status, F.lit("NONE")))
    unsafe = (safety == "UNSAFE") | matches_any(q, w.INTENT_OVERRIDE)
    large = (domain.isin("STEM", "LEGAL")) | (status == "NO_INFO_VALID") | (F.length(question) > 350) | refusal_key(opts).isNotNull()
    key = F.when(status == "NO_INFO_VALID", refusal_key(opts))
    tag = F.concat(F.lit("AI-"), domain, F.when(large, "-L").otherwise("-S"))
    return F.when(unsafe, _route(yes, no, no, F.lit("BLOCKED-AI-BLOCKED"), blocked_key(opts), F.lit("SAFETY"))).otherwise(
        _route(no, domain == "STEM", large, tag, key, F.when(key.isNotNull(), "NO_INFO").otherwise("TRAP"))
    )


def political_rescue(question: Column) -> Column:
    """Whether a question that the older router's model calls unsafe is a historical one after all."""
    q = lower(question)
    return contains_any(q, w.RESCUE) & ~contains_any(q, w.NO_RESCUE)


def route_model_old(question: Column, opts: Column, safety: Column, domain: Column) -> Column:
    """The older model router: rescue, then intent, large from 500 characters on, a no-information option kept for STEM only; an unreadable reply takes the older rules."""
    q, no, yes = lower(question), F.lit(False), F.lit(True)
    told, domain = F.upper(safety), F.upper(F.coalesce(domain, F.lit("SOCIAL")))
    unsafe = ((told == "UNSAFE") & ~political_rescue(question)) | matches_any(q, w.INTENT_OVERRIDE_OLD)
    stem = domain == "STEM"
    large = stem | (domain == "LEGAL") | (F.length(question) > 500)
    key = F.when(stem & (refusal_type(opts) == "NO_INFO"), refusal_key(opts))
    tag = F.concat(F.lit("AI-"), domain, F.when(large, "-L").otherwise("-S"))
    blocked = _route(yes, no, no, F.lit("BLOCKED-AI-BLOCKED"), blocked_key(opts), F.lit("SAFETY"))
    open_ = _route(no, stem, large, tag, key, F.when(key.isNotNull(), "NO_INFO"))
    return F.when(told.isNull(), route_rules_old(question, opts)).when(unsafe, blocked).otherwise(open_)


def confirmed_unsafe(reply: Column) -> Column:
    """The safety filter's reply says UNSAFE; no reply says nothing."""
    return F.contains(F.upper(F.coalesce(reply, F.lit(""))), F.lit("UNSAFE"))


def route_four(question: Column) -> Column:
    """BLOCKED, STEM, COMPLEX or SIMPLE."""
    q = lower(question)
    calculate = F.contains(q, F.lit(w.FOUR_CALCULATE)) & ~contains_any(q, w.FOUR_NOT_CALCULATE)
    return (
        F.when(contains_any(q, w.FOUR_HARD_BAN), "BLOCKED")
        .when(contains_any(q, w.FOUR_SOFT_BAN) & ~contains_any(q, w.FOUR_WHITELIST), "BLOCKED")
        .when(F.coalesce(question, F.lit("")).rlike(w.FOUR_MATH) | contains_any(q, w.FOUR_STEM) | calculate, "STEM")
        .when(contains_any(q, w.FOUR_LOGIC), "COMPLEX")
        .otherwise("SIMPLE")
    )


def answer_aware_block(opts: Column) -> Column:
    """Without a model: a safety option blocks, a no-information option is a hint."""
    return F.when(refusal_type(opts) == "SAFETY", "BLOCKED-ANSWER").when(refusal_type(opts) == "NO_INFO", "NO_INFO_HINT").otherwise("OPEN")


def context_safe(question: Column, context: Column) -> Column:
    """True where every suspicious word of the question is also in the retrieved text."""
    q, c = lower(question), lower(context)
    unsafe = [F.contains(q, F.lit(word)) & ~F.contains(c, F.lit(word)) for word in w.SOFT_BAN + w.HARD_BAN]
    out = ~unsafe[0]
    for test in unsafe[1:]:
        out = out & ~test
    return out


# --- answers


def all_above(text: Column) -> Column:
    return matches_any(lower(text), w.ALL_ABOVE)


def _valid(letter: Column, opts: Column) -> Column:
    up = F.upper(F.nullif(letter, F.lit("")))
    return F.when(F.exists(opts, lambda o: o["key"] == up), up)


def extract_answer(reply: Column, opts: Column, strict_word: bool = False) -> Column:
    """The letter a reply names: strict patterns in order, then the last bold letter, then loose ones; only options count.

    Case is folded by lower-casing, for the alphabet's sake. strict_word: the
    letter must not begin a word.
    """
    text = F.trim(F.coalesce(reply, F.lit("")))
    low = F.lower(text)
    after = r"(?![\p{L}\p{N}_])" if strict_word else ""
    tries = [_valid(F.regexp_extract(low, p.replace("([a-z])", f"([a-z]){after}"), 1), opts) for p in w.ANSWER_STRICT]
    bold = F.regexp_extract_all(text, F.lit(r"\*\*([A-Z])\*\*"), F.lit(1))
    tries.append(_valid(F.get(bold, F.size(bold) - 1), opts))
    tries += [_valid(F.regexp_extract(low, p, 1), opts) for p in w.ANSWER_LOOSE]
    return F.coalesce(*tries)


def overlap_answer(question: Column, opts: Column) -> Column:
    """The option that shares most distinct tokens with the question, the first of equals."""
    asked = tokens(question)
    scored = F.transform(opts, lambda o, i: F.struct(F.size(F.array_intersect(tokens(o["text"]), asked)).alias("n"), (-i).alias("place"), o["key"].alias("key")))
    return F.array_max(scored)["key"]


def longest_answer(opts: Column) -> Column:
    return F.array_max(F.transform(opts, lambda o, i: F.struct(F.length(o["text"]).alias("n"), (-i).alias("place"), o["key"].alias("key"))))["key"]


def first_number(text: Column) -> Column:
    """The first run of digits and points as a number, null if it is none."""
    return F.regexp_extract(text, r"([\d\.]+)", 1).try_cast("double")


def _extreme(opts: Column, sign: int) -> Column:
    numbers = F.transform(opts, lambda o, i: F.struct((sign * first_number(o["text"])).alias("n"), (-i).alias("place"), o["key"].alias("key")))
    return F.array_max(F.filter(numbers, lambda x: x["n"].isNotNull()))["key"]


def math_answer(question: Column, opts: Column) -> Column:
    """Unit of the question, then change words, then most, then least, then the middle numeric option, then C."""
    q = lower(question)
    unit = F.nullif(F.regexp_extract(q, rf"(?<![\p{{L}}\p{{N}}_])({w.UNITS})(?![\p{{L}}\p{{N}}_])", 1), F.lit(""))
    by_unit = F.when(unit.isNotNull(), _first(F.filter(opts, lambda o: F.contains(lower(o["text"]), unit))))
    by_change = F.when(contains_any(q, w.CHANGE_WORDS), _first(F.filter(opts, lambda o: contains_any(lower(o["text"]), ["%", "+", "tăng"]))))
    numeric = F.filter(opts, lambda o: o["text"].rlike(r"\d"))
    middle = F.get(numeric, F.floor(F.size(numeric) / 2).cast("int"))["key"]
    return F.coalesce(by_unit, by_change, F.when(contains_any(q, w.MOST_WORDS), _extreme(opts, 1)), F.when(contains_any(q, w.LEAST_WORDS), _extreme(opts, -1)), middle, F.lit("C"))


def math_answer_old(opts: Column) -> Column:
    """C, else B, else the first numeric option, else the first."""
    keys = F.transform(opts, lambda o: o["key"])
    return F.coalesce(F.when(F.array_contains(keys, "C"), "C"), F.when(F.array_contains(keys, "B"), "B"), _first(F.filter(opts, lambda o: o["text"].rlike(r"\d"))), _first(opts))


def contradicts(answer: Column, opts: Column) -> Column:
    """The chosen option says 'all of them' while another is a refusal."""
    chosen = F.get(F.filter(opts, lambda o: o["key"] == answer), F.lit(0))["text"]
    return F.coalesce(all_above(chosen) & (refusal_key(opts) != answer), F.lit(False))


def uncertain(reply: Column, answer: Column) -> Column:
    """No letter, or a reply that speaks of missing information."""
    low = lower(reply)
    return answer.isNull() | (F.contains(low, F.lit(w.NOT)) & F.contains(low, F.lit(w.INFORMATION)))


def checked_answer(reply: Column, answer: Column, opts: Column, hint_key: Column, hint_type: Column, use_hint: bool = False) -> Column:
    """The letter after the checks: an uncertain one gives way to a no-information hint (if such hints are used), one that contradicts the options goes."""
    hinted = F.when((hint_type == "NO_INFO") & uncertain(reply, answer), hint_key) if use_hint else F.lit(None).cast("string")
    last = F.coalesce(hinted, answer)
    return F.when(~contradicts(last, opts), last)


# --- prompts


def context_block(texts: Column, limit: int, first: int | None = None, squeezed: bool = False) -> Column:
    """Numbered paragraphs, each cut to the limit."""
    texts = F.slice(texts, 1, first) if first else texts
    body = lambda t: F.substring(squeeze(t) if squeezed else t, 1, limit)
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), body(t))), "\n\n")


def context_words(texts: Column, words: int) -> Column:
    """Numbered paragraphs of the first words each."""
    body = lambda t: F.array_join(F.slice(F.split(squeeze(t), " "), 1, words), " ")
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), body(t), F.lit("..."))), "\n\n")


def titled_context(titles: Column, texts: Column) -> Column:
    """Whole paragraphs, each under the title of its source."""
    both = F.arrays_zip(titles.alias("title"), texts.alias("text"))
    return F.array_join(F.transform(both, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), F.coalesce(x["title"], F.lit("Unknown")), F.lit(")\n"), x["text"])), "\n\n")


def options_block(opts: Column) -> Column:
    return F.array_join(F.transform(opts, lambda o: F.concat(o["key"], F.lit(". "), o["text"])), "\n")


def messages(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def trace_status(answer: Column, truth: Column) -> Column:
    return F.when(truth.isNull(), "unlabelled").when(F.trim(answer) == F.trim(truth), "right").otherwise("wrong")


def trace_line(key: Column, answer: Column, truth: Column) -> Column:
    shown = F.coalesce(F.trim(truth), F.lit("-"))
    return F.concat(F.lit("["), key.cast("string"), F.lit("] "), F.upper(trace_status(answer, truth)), F.lit(" answer="), F.coalesce(F.trim(answer), F.lit("-")), F.lit(" truth="), shown)


# --- older variants


def extract_two_step(reply: Column, opts: Column) -> Column:
    """The heading's letter, a bold one, the last lone capital that is an option, else the first option."""
    text = F.trim(F.coalesce(reply, F.lit("")))
    lone = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])([A-Z])(?![\p{L}\p{N}_])"), F.lit(1))
    named = F.filter(lone, lambda x: F.exists(opts, lambda o: o["key"] == x))
    return F.coalesce(
        _valid(F.regexp_extract(F.lower(text), w.ANSWER_STRICT[0], 1), opts),
        _valid(F.regexp_extract(text, r"\*\*([A-Z])\*\*", 1), opts),
        F.get(named, F.size(named) - 1),
        _first(opts),
    )


def overlap_answer_negated(question: Column, opts: Column) -> Column:
    """A negated question takes the longest option, any other the one that overlaps most."""
    return F.when(contains_any(lower(question), w.NEGATIVE_WORDS), longest_answer(opts)).otherwise(overlap_answer(question, opts))


def refusal_reply(reply: Column) -> Column:
    """The model says that it does not know."""
    return contains_any(lower(reply), w.REFUSAL_REPLIES)


def refusal_key_old(opts: Column) -> Column:
    """Phrases of a refusal before phrases of missing information."""
    return F.coalesce(_first(_where(opts, lambda t: contains_any(t, w.OLD_REFUSALS))), _first(_where(opts, lambda t: contains_any(t, w.OLD_NO_INFO))))


def route_rules_old(question: Column, opts: Column) -> Column:
    """The older fallback: dirty words, intent, a safety option, else open; a no-information key stays for mathematics only."""
    q, no, yes, none = lower(question), F.lit(False), F.lit(True), F.lit(None)
    blocked = lambda tag: _route(yes, no, no, F.lit(f"BLOCKED-{tag}"), blocked_key(opts), F.lit("SAFETY"))
    math = F.coalesce(question, F.lit("")).rlike(w.MATH_HINT)
    key = F.when(math & (refusal_type(opts) == "NO_INFO"), refusal_key(opts))
    return (
        F.when(contains_any(q, w.OLD_DIRTY), blocked("REGEX-DIRTY"))
        .when(matches_any(q, w.OLD_BAD_INTENT), blocked("REGEX-INTENT"))
        .when(refusal_type(opts) == "SAFETY", blocked("REGEX-ANS-SAFETY"))
        .otherwise(_route(no, math, yes, F.lit("REGEX-FALLBACK"), key, F.when(key.isNotNull(), "NO_INFO").otherwise(none)))
    )


def sensitive_topic(question: Column) -> Column:
    """The older two-state test: a listed word without an academic one."""
    q = lower(question)
    return contains_any(q, w.OLD_BLACKLIST) & ~contains_any(q, w.OLD_WHITELIST)


def hard_axes(question: Column) -> Column:
    """struct(is_math, is_legal): what the older router knows without a model."""
    q = lower(question)
    return F.struct(F.coalesce(question, F.lit("")).rlike(w.MATH_HARD).alias("is_math"), contains_any(q, w.LEGAL_HARD).alias("is_legal"))


def axes_reply(reply: Column) -> Column:
    """A three-axis text reply: struct(is_unsafe, is_stem, is_complex) by words; an empty one is safe, social and complex."""
    up = F.upper(F.coalesce(reply, F.lit("")))
    return F.struct(F.contains(up, F.lit("UNSAFE")).alias("is_unsafe"), F.contains(up, F.lit("STEM")).alias("is_stem"), (F.contains(up, F.lit("COMPLEX")) | (up == "")).alias("is_complex"))
