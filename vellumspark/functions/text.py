"""Text columns: clean-up, tokens, flags, categories, ids. All JVM-side but for composing characters and segmenting words."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import words as w

#: uuid5 name spaces for DNS names and URLs (RFC 9562)
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: White space and the 32 ASCII punctuation marks
TOKEN_GAP = r"[ \t\n\r\f\x0B!-/:-@\[-`{-~]+"


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Literal substring test for any phrase."""
    return any_of([F.contains(text, F.lit(p)) for p in phrases])


def matches_any(text: Column, patterns: list[str]) -> Column:
    return any_of([text.rlike(p) for p in patterns])


def lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed normal form. Keyword rules match composed text only; no built-in expression composes."""
    return texts.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


@F.pandas_udf(ArrayType(StringType()))
def nfc_all(lists: pd.Series) -> pd.Series:
    """The same for every text of an array."""
    return lists.map(lambda x: x if x is None else [y if y is None else unicodedata.normalize("NFC", y) for y in x])


def clean_spaces(text: Column) -> Column:
    """Non-breaking spaces to spaces, zero-width characters and carriage returns removed, lines trimmed."""
    plain = F.translate(text, " ​‌‍﻿\r", " ")
    return F.array_join(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), "\n")


def tokens(text: Column) -> Column:
    """Lower-case words; the 32 ASCII punctuation marks count as spaces; null gives an empty array."""
    return F.filter(F.split(lower(text), TOKEN_GAP), lambda t: t != "")


def segmented(segment: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A tokenizer like ``tokens`` whose words a segmenter groups: it gets the words joined by spaces, a batch at a time if it has ``many``."""
    many = getattr(segment, "many", lambda texts: map(segment, texts))

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[w for w in words if w] for words in many(texts)], index=texts.index, dtype=object)

    return lambda text: run(F.array_join(tokens(text), " "))


class LongestMatch:
    """Groups the longest known phrases from the left, joined by underscores."""

    def __init__(self, phrases: list[str]):
        self.phrases = {tuple(p.split()) for p in phrases}
        self.longest = max(map(len, self.phrases), default=1)

    def __call__(self, text: str) -> list[str]:
        words, out, at = text.split(), [], 0
        while at < len(words):
            n = next((n for n in range(min(self.longest, len(words) - at), 1, -1) if tuple(words[at : at + n]) in self.phrases), 1)
            out.append("_".join(words[at : at + n]))
            at += n
        return out


def word_count(text: Column) -> Column:
    """Runs of word characters of any script. By splitting: counting matches copies the text for each of them."""
    return F.size(F.filter(F.split(text, w.NOT_W + "+"), lambda t: t != ""))


def approx_tokens(text: Column) -> Column:
    """Words times 1.3, rounded down."""
    return F.floor(F.size(F.filter(F.split(text, r"\s+"), lambda t: t != "")) * 1.3).cast("long")


def strip_citations(text: Column, digits_only: bool = True) -> Column:
    return F.regexp_replace(text, w.CITATION_DIGITS if digits_only else w.CITATION, "")


def join_lone_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\n)\n(?!\n)", ". ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def break_before_markers(text: Column) -> Column:
    """A newline before every article or chapter marker that stands inside a line."""
    return F.regexp_replace(text, w.MARKER_INSIDE, "\n")


def wiki_clean(text: Column) -> Column:
    """The encyclopedia profile: footer, citations, lone newlines, then all white space to single spaces."""
    return squeeze(join_lone_newlines(strip_citations(cut_footer_wiki(text))))


def cut_footer_wiki(text: Column) -> Column:
    lines = F.split(text, "\n")
    is_footer = F.transform(lines, lambda x: (F.length(F.trim(x)) < 40) & F.btrim(F.lower(F.trim(x)), F.lit(".:-=")).isin(w.FOOTER_WIKI))
    return _before(lines, is_footer)


def cut_footer(text: Column) -> Column:
    """Ends the text before the first short heading line that names a reference section."""
    lines = F.split(text, "\n")

    def footer(line: Column) -> Column:
        core = F.lower(F.trim(line))
        heading = core.startswith("=") | core.startswith("#") | (line == F.upper(line))
        return (F.length(core) < 50) & heading & F.btrim(core, F.lit("=#-:. ")).isin(w.FOOTER_STEM)

    return _before(lines, F.transform(lines, footer))


def _before(lines: Column, marks: Column) -> Column:
    at = F.array_position(marks, True)
    return F.when(at > 0, F.array_join(F.slice(lines, F.lit(1), at.cast("int") - 1), "\n")).otherwise(F.array_join(lines, "\n"))


def table_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.ltrim(x).startswith("|")))


def content_flags(text: Column) -> dict[str, Column]:
    """The stem profile."""
    low = F.lower(text)
    return {
        "has_math": matches_any(text, w.MATH_STEM),
        "has_formula": matches_any(text, w.FORMULA_STEM) | text.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){w.FORMULA_ASSIGN}"),
        "has_table": table_lines(text) >= 2,
        "has_list": F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"^(?:{w.LIST_ITEM})"))) >= 2,
        "has_legal": matches_any(low, w.LEGAL_STEM),
        "is_substantial": word_count(text) >= 20,
    }


def content_flags_sub(text: Column) -> dict[str, Column]:
    """The submission profile."""
    return {"has_math": text.rlike(w.MATH_SUB), "has_legal": F.lower(text).rlike(w.LEGAL_SUB), "is_substantial": word_count(text) >= 15}


def _timeline(text: Column) -> Column:
    return contains_any(text, w.TIMELINE) & text.rlike(r"\d")


def keep_chunk_wiki(text: Column) -> Column:
    return ((F.length(text) >= 30) | _timeline(text)) & ~(F.contains(text, F.lit("Mục lục")) & (F.length(text) < 50))


def keep_chunk_stem(text: Column, least: int = 50) -> Column:
    f = content_flags(text)
    return (F.length(text) >= least) | f["has_formula"] | f["has_table"] | f["has_legal"]


def keep_chunk_sub(text: Column) -> Column:
    f = content_flags_sub(text)
    return (F.length(text) >= 50) | f["has_math"] | f["has_legal"] | _timeline(text)


def _path(category: Column) -> Column:
    return F.transform(F.split(category, ">"), lambda p: F.trim(p))


def short_category(category: Column) -> Column:
    """First and last of a path, the first abbreviated."""
    parts = _path(category)
    first, last = (F.replace(F.element_at(parts, i), F.lit("_"), F.lit(" ")) for i in (1, -1))
    short = first
    for name, abbreviation in w.CATEGORY_SHORT.items():
        short = F.when(first == name, abbreviation).otherwise(short)
    return F.when(F.size(parts) == 1, first).otherwise(F.concat(short, F.lit("-"), last))


def short_category_sub(category: Column) -> Column:
    """The submission profile: first word of the first, then the last."""
    parts = _path(F.when(F.coalesce(category, F.lit("")) == "", "Tổng hợp").otherwise(category))
    both = F.concat(F.element_at(F.split(F.element_at(parts, 1), "_"), 1), F.lit("-"), F.element_at(parts, -1))
    return F.replace(F.when(F.size(parts) > 1, both).otherwise(F.element_at(parts, 1)), F.lit("_"), F.lit(" "))


def domain(category: Column, stem: list[str] = w.STEM_DOMAIN, legal: list[str] = w.LEGAL_DOMAIN) -> Column:
    low = lower(category)
    return F.when(contains_any(low, stem), "stem").when(contains_any(low, legal), "legal").otherwise("general")


def first_category(categories: Column, default: str = "Uncategorized") -> Column:
    return F.replace(F.coalesce(F.get(categories, F.lit(0)), F.lit(default)), F.lit("_"), F.lit(" "))


def category_path(categories: Column) -> Column:
    return F.array_join(categories, " > ")


def prefix_wiki(category: Column, title: Column, content: Column) -> Column:
    return F.concat(F.lit("Lĩnh vực: "), category, F.lit(". Chủ đề: "), title, F.lit(".\nNội dung: "), content)


def prefix_stem(short: Column, content: Column) -> Column:
    return F.concat(F.lit("["), short, F.lit("] "), content)


def prefix_sub(short: Column, title: Column, content: Column) -> Column:
    return F.concat(F.lit("["), short, F.lit("] "), title, F.lit("\n"), content)


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """uuid5 of the name, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("long").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def slug_title(url: Column) -> Column:
    """The last part of a URL path as a title."""
    return F.initcap(F.translate(F.element_at(F.split(F.regexp_replace(url, r"/+$", ""), "/"), -1), "-_", "  "))


def iso_time(at: Column) -> Column:
    """A timestamp as ISO text, in the session's time zone; the clock is the caller's."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def day_month_year(at: Column) -> Column:
    return F.date_format(at, "dd/MM/yyyy")


def syntax_issues(text: Column) -> Column:
    """'lower-case start', 'no final mark', both, or 'OK'."""
    start = F.when(text.rlike("^[a-zà-ỹ]"), "lower-case start")
    end = F.when(~F.right(text, F.lit(1)).isin(".", "!", "?", '"', "'"), "no final mark")
    both = F.concat_ws(", ", start, end)
    return F.when(F.length(text) == 0, "empty").when(both == "", "OK").otherwise(both)


def keep_lines(text: Column, denied: list[str] = w.GARBAGE_LINES, longer: int = 5) -> Column:
    """Trimmed lines without denied words (in any case) and longer than ``longer``."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: (F.length(x) > longer) & ~contains_any(F.lower(x), denied)), "\n")


def uuid5_namespace(stored: Column, name: Column) -> Column:
    """'dns', 'url' or 'neither': the name space in which the stored id is the name's uuid5."""
    return F.when(stored == uuid5(name), "dns").when(stored == uuid5(name, URL_NAMESPACE), "url").otherwise("neither")
