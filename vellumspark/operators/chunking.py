"""Structure-aware cleaning, recursive splitting, statute parsing, and the chunk table.

Cleaning and splitting walk text in order, which no built-in expression does, so
they are Arrow-batched functions; everything around them stays in columns.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions import words as w
from .retrieval import spread
from .tables import remaining

_CITATION = re.compile(w.CITATION)
_LIST = re.compile(r"(?:[\-\*•]|\d+\.)\s")
_FORMULA = re.compile(r"\$|\\[a-z]+\{|[∑∫√±≠≤≥]")

#: Separators of each splitter profile, tried in order.
SEPARATORS = {
    "legal": ["\n\nĐiều ", "\n\nKhoản ", "\n\nChương ", "\n\n", "\n1. ", "\n2. ", "\n3. ", "\n4. ", "\n5. ", "\n", ". ", "; ", ", ", " ", ""],
    "stem": ["\n\n", "\n### ", "\n- ", "\n• ", "\n* ", "\n1. ", "\n2. ", "\n3. ", "\n", "; ", ". ", ", ", " ", ""],
    "technical": ["\n```", "\n\n", "\n## ", "\n- ", "\n", "; ", ". ", " ", ""],
    "general": ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""],
    "wiki": ["\n\n", "\n", ". ", "; ", ", ", " ", ""],
    "legal_sub": ["\n\nĐiều ", "\n\nKhoản ", "\n\nChương ", "\n\n", "\n", "; ", ". ", " "],
    "stem_sub": ["\n\n", "\n### ", "\n- ", "\n1. ", "\n", "; ", ". ", " "],
    "general_sub": ["\n\n", "\n", ". ", "; ", ", ", " ", ""],
}


def line_kind(line: str) -> str:
    """table, list, formula or prose."""
    if line.startswith("|"):
        return "table"
    if _LIST.match(line):
        return "list"
    return "formula" if _FORMULA.search(line) else "prose"


def structured(text: str | None, prose_glue: str = "\n\n") -> str:
    """Blocks of one kind, joined by blank lines; structures keep their lines and blanks, citations go. Characters are composed first: the rules after it match composed text only."""
    marked: list[tuple[str, str]] = []
    for line in map(str.strip, unicodedata.normalize("NFC", text or "").split("\n")):
        if line:
            line = _CITATION.sub("", line)
            marked.append((line_kind(line), line))
        elif marked and marked[-1][0] != "prose":
            marked.append((marked[-1][0], ""))
    glue = lambda kind: prose_glue if kind == "prose" else "\n"
    return "\n\n".join(glue(kind).join(line for _, line in run) for kind, run in itertools.groupby(marked, key=lambda m: m[0]))


#: What joins the prose lines of a cleaned text.
_GLUE = {"stem": "\n\n", "sub": "\n"}


def clean_structured(text: Column, profile: str = "stem") -> Column:
    """Footer cut, then structure cleaning. profile: stem (prose lines become paragraphs) or sub (they stay lines)."""
    glue = _GLUE[profile]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: structured(x, glue))

    return run(t.cut_footer(F.coalesce(text, F.lit(""))))


def structured_rows(df: DataFrame, text: str, keep: list[str], profile: str = "stem", out: str = "clean") -> DataFrame:
    """(keep, out): the texts of ``clean_structured`` as rows that leave a task as they are made, whatever their number and length."""
    glue = _GLUE[profile]
    cut = df.select(*keep, t.cut_footer(F.coalesce(text, F.lit(""))).alias("_cut"))
    return piece_rows(cut, lambda x: iter((structured(x, glue),)), ["_cut"], keep, "_place", out).drop("_place")


def composed_rows(df: DataFrame, text: str, keep: list[str], out: str) -> DataFrame:
    """(keep, out): the texts with composed characters, null ones empty, as rows that leave a task as they are made."""
    return piece_rows(df, lambda x: iter((unicodedata.normalize("NFC", x or ""),)), [text], keep, "_place", out).drop("_place")


def _cut_at(text: str, separator: str, keep: bool) -> Iterator[str]:
    """The parts that are not empty, one at a time; keep: each but the first begins with the separator."""
    if not separator:
        yield from text
        return
    begin = body = 0
    while True:
        end = text.find(separator, body)
        if part := text[begin : end if end >= 0 else None]:
            yield part
        if end < 0:
            return
        body = end + len(separator)
        begin = end if keep else body


def _windows(parts: Iterable[str], glue: str, size: int, overlap: int, length: Callable[[str], int]):
    """Greedy joins of at most ``size``; each begins with up to ``overlap`` of the one before."""
    held: deque[tuple[str, int]] = deque()
    total, gap = 0, length(glue)
    for part in parts:
        n = length(part)
        if held and total + gap + n > size:
            yield glue.join(p for p, _ in held)
            while held and (total > overlap or total + gap + n > size):
                total -= held.popleft()[1] + (gap if held else 0)
        total += n + (gap if held else 0)
        held.append((part, n))
    if held:
        yield glue.join(p for p, _ in held)


def split_pieces(text: str | None, separators: list[str], size: int = 1024, overlap: int = 200, keep: bool = False, length: Callable[[str], int] = len) -> Iterator[str]:
    """Chunks of at most ``size`` where the separators allow, stripped, blanks dropped, one at a time.

    The first separator that occurs cuts the text; small pieces are joined
    again, larger ones are cut by the separators after it (as a public splitter
    is described to do).  keep: a separator begins the piece that follows it.
    """
    text = text or ""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    for small, parts in itertools.groupby(_cut_at(text, separator, keep), key=lambda part: length(part) < size):
        if small:
            found = _windows(parts, "" if keep else separator, size, overlap, length)
        elif finer:
            found = itertools.chain.from_iterable(split_pieces(part, finer, size, overlap, keep, length) for part in parts)
        else:
            found = parts
        yield from filter(None, map(str.strip, found))


def split_text(text: str | None, separators: list[str], size: int = 1024, overlap: int = 200, keep: bool = False, length: Callable[[str], int] = len) -> list[str]:
    """The chunks of ``split_pieces`` in a list."""
    return list(split_pieces(text, separators, size, overlap, keep, length))


def piece_rows(df: DataFrame, pieces: Callable[..., Iterator[str]], using: list[str], keep: list[str], place: str = "chunk_index", out: str = "content", held_chars: int = 1 << 20) -> DataFrame:
    """One row for each piece that ``pieces`` makes of the columns ``using``: the columns ``keep``, its place from 0, and the piece.

    Rows leave a task as they are made, about ``held_chars`` characters at a time,
    so that a text's pieces are never held together.  The names of the two new
    columns must be free.
    """
    if {place.lower(), out.lower()} & {c.lower() for c in keep}:
        raise ValueError(f"{place} or {out} is a column that is kept")
    fields = {f.name: f for f in df.select(*keep).schema}
    schema = T.StructType([*(fields[c] for c in keep), T.StructField(place, T.IntegerType()), T.StructField(out, T.StringType())])
    n = len(using)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.RecordBatch.from_arrays(batch.columns[n:], keep) if keep else None
            rows, places, made, size = [], [], [], 0

            def flush() -> pa.RecordBatch:
                nonlocal rows, places, made, size
                columns = kept.take(pa.array(rows, pa.int32())).columns if keep else []
                ready = pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int32()), pa.array(made, pa.string())], [*keep, place, out])
                rows, places, made, size = [], [], [], 0
                return ready

            for i in range(batch.num_rows):
                for at, piece in enumerate(pieces(*(batch.column(c)[i].as_py() for c in range(n)))):
                    rows.append(i)
                    places.append(at)
                    made.append(piece)
                    size += len(piece) + 16
                    if size >= held_chars:
                        yield flush()
            if rows:
                yield flush()
            del batch, kept  # before the next one is read

    given = [F.col(c).alias(f"_using{i}") for i, c in enumerate(using)]
    return df.select(*given, *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]).mapInArrow(run, schema)


def split_rows(df: DataFrame, text: str, keep: list[str], profile: str = "general", size: int = 1024, overlap: int = 200, length: Callable[[str], int] = len) -> DataFrame:
    """(keep, chunk_index, content): the chunks of ``split_column`` as rows, for texts of any length."""
    separators, keeps = SEPARATORS[profile], profile.endswith("_sub") or profile == "wiki"
    return piece_rows(df, lambda x: split_pieces(x, separators, size, overlap, keeps, length), [text], keep)


def split_column(text: Column, profile: str = "general", size: int = 1024, overlap: int = 200, length: Callable[[str], int] = len) -> Column:
    """Array of chunks. Profiles that end in _sub keep separators."""
    separators, keep = SEPARATORS[profile], profile.endswith("_sub") or profile == "wiki"

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: split_text(x, separators, size, overlap, keep, length))

    return run(text)


def approx_token_length(text: str) -> int:
    return int(len(text.split()) * 1.3)


def split_by_domain(text: Column, domain: Column, suffix: str = "", size: int = 1024, overlap: int = 200) -> Column:
    """One pass over the rows, the separators chosen by the domain column."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, domains: pd.Series) -> pd.Series:
        lists = [split_text(x, SEPARATORS.get(f"{d}{suffix}", SEPARATORS[f"general{suffix}"]), size, overlap, bool(suffix)) for x, d in zip(texts, domains, strict=True)]
        return pd.Series(lists)

    return run(text, domain)


def with_header(title: Column, text: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), text)


def chunk_articles(articles: DataFrame, profile: str = "stem", least: int = 100, size: int = 1024, overlap: int = 200, domain_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """raw_articles to chunks: category, domain, cleaning, minimum length, header, splitting, filter, enrichment.

    profile: stem, sub (submission) or wiki.  chunk_index counts before the
    filter, so ids may have gaps.  domain_of: the domain of a category, in place of
    the profile's rules (wiki has one domain); it chooses the separators, those of
    "general" for domains that have none, and a null domain is "general".
    """
    articles = articles if articles.isStreaming else spread(articles.select("title", "url", "text", "categories"))
    if profile == "wiki":
        category = t.first_category(F.col("categories"))
        rows = composed_rows(articles.select("title", "url", category.alias("category"), "text"), "text", ["title", "url", "category"], "text")
        rows = rows.withColumns({"text": t.wiki_clean(F.col("text")), "domain": F.lit("general"), "short": F.col("category")}).filter(F.length("text") >= 50)
        pieces = lambda x, title, domain: split_pieces(x, SEPARATORS["wiki"], 512, 128, True, approx_token_length)
        keep = t.keep_chunk_wiki
    else:
        category = F.coalesce(F.nullif(t.category_path(F.col("categories")), F.lit("")), F.lit("Uncategorized"))
        lists = (w.STEM_DOMAIN, w.LEGAL_DOMAIN) if profile == "stem" else (w.STEM_DOMAIN_SUB, w.LEGAL_DOMAIN_SUB)
        rows = articles.select("title", "url", category.alias("category"), t.cut_footer(F.coalesce("text", F.lit(""))).alias("text"))
        told = (domain_of or (lambda category: t.domain(category, *lists)))(F.col("category"))
        short = t.short_category(F.col("category")) if profile == "stem" else t.short_category_sub(F.col("category"))
        rows = rows.withColumns({"domain": F.coalesce(told, F.lit("general")), "short": short})
        suffix, glue = "" if profile == "stem" else "_sub", _GLUE[profile]

        def pieces(x: str, title: str | None, domain: str) -> Iterator[str]:
            """Cleaning, header and splitting in one pass over the texts."""
            clean = structured(x, glue)
            if title is not None and len(clean) >= least:
                separators = SEPARATORS.get(f"{domain}{suffix}", SEPARATORS[f"general{suffix}"])
                yield from split_pieces(f"# {title}\n\n{clean}", separators, size, overlap, bool(suffix))

        keep = t.keep_chunk_stem if profile == "stem" else t.keep_chunk_sub
    chunks = piece_rows(rows, pieces, ["text", "title", "domain"], ["title", "url", "category", "domain", "short"])
    return enrich(chunks.filter(keep(F.col("content"))), profile)


def enrich(chunks: DataFrame, profile: str) -> DataFrame:
    """The canonical chunk table from title, url, category, domain, short, chunk_index, content."""
    content = F.col("content")
    vector = {"wiki": t.prefix_wiki(F.col("short"), F.col("title"), content), "stem": t.prefix_stem(F.col("short"), content), "sub": t.prefix_sub(F.col("short"), F.col("title"), content)}[profile]
    flags = t.content_flags(content)
    if profile == "sub":
        flags |= {k: v for k, v in t.content_flags_sub(content).items() if k in ("has_math", "has_legal")}
    return chunks.select(
        F.concat_ws("_", "title", F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("title").alias("doc_title"),
        F.col("category").alias("doc_category"),
        vector.alias("vector_text"),
        content.alias("display_text"),
        F.col("url").alias("doc_url"),
        "domain",
        "chunk_index",
        *[flags[k].alias(k) for k in ("has_math", "has_formula", "has_table", "has_list", "has_legal")],
        F.length(content).alias("char_count"),
        t.word_count(content).alias("word_count"),
    )


def chunk_new(articles: DataFrame, done_titles: DataFrame, profile: str = "stem", **how) -> DataFrame:
    """Chunks of the articles whose title is not in the state table yet."""
    return chunk_articles(remaining(articles, done_titles, "title"), profile, **how)


# --- statutes


class StatuteRules:
    """How a statute parser reads lines.

    article and context: patterns of lines that open an article or a chapter;
    titles: whether other upper-case lines join the context; garbage: lines with
    any of these (in any case, if fold) are skipped; breaks: put markers inside lines on lines of their own;
    upper-case lines under ``title_below`` characters end an article in any case;
    leaders: dots that mark a line of a table of contents.
    """

    def __init__(self, article: str, context: str, titles: bool, garbage: list[str], shortest: int = 1, breaks: bool = False, not_title: tuple[str, ...] = ("ĐIỀU",), leaders: str = "", title_below: int = 100, fold: bool = False):
        self.title_below = title_below
        self.article, self.context = re.compile(article), re.compile(context, re.IGNORECASE)
        self.titles, self.garbage, self.shortest, self.breaks, self.not_title, self.leaders = titles, garbage, shortest, breaks, not_title, leaders

        self.fold = fold

    def is_garbage(self, line: str) -> bool:
        return any(x.lower() in line.lower() if self.fold else x in line for x in self.garbage) or bool(self.leaders and self.leaders in line)

    def is_title(self, line: str) -> bool:
        return line.isupper() and len(line) < self.title_below and not any(x in line for x in self.not_title)


#: Patterns and words of the parser's option sets.
STATUTE_RULES = {
    "v1": StatuteRules(r"Điều \d+[\.\:\s]", r"(CHƯƠNG|MỤC|PHẦN) [IVX0-9]+", False, ["TVPL"], shortest=5),
    "v2": StatuteRules(r"Điều \d+[\.\:\s]", r"(CHƯƠNG|MỤC|PHẦN) [IVX0-9]+", False, [], breaks=True, leaders=".......", title_below=150),
    "v3": StatuteRules(r"Điều \d+[\.\:\s]", r"(CHƯƠNG|MỤC|PHẦN) [IVX0-9]+", False, [], shortest=3, breaks=True, not_title=("ĐIỀU", "CỘNG HÒA"), leaders="......", title_below=150),
    "v4": StatuteRules(r"Điều \d+[\.\:\s]", r"(CHƯƠNG|MỤC|PHẦN) [IVX0-9]+", False, w.STATUTE_GARBAGE_WIDE, shortest=3, breaks=True, not_title=("ĐIỀU", "CỘNG HÒA"), title_below=150, fold=True),
    "strict": StatuteRules(r"(?i:Điều\s+\d+)", r"(CHƯƠNG|MỤC|PHẦN)\s+", True, w.STATUTE_GARBAGE, not_title=("ĐIỀU", "CỘNG HÒA")),
}
_MARKER = re.compile(w.MARKER_INSIDE)


def statute_articles(text: str | None, title: str, rules: StatuteRules) -> Iterator[str]:
    """One text per article, as it ends: document title, chapter context, article line, body."""
    text = _MARKER.sub("\n", text or "") if rules.breaks else text or ""
    context: list[str] = []
    article: tuple[str, list[str]] | None = None  # context and lines
    open_ = False

    def whole() -> str:
        above, lines = article
        return f"Văn bản: {title}\n{above}\n{lines[0]}\n{chr(10).join(lines[1:])}".strip()

    for line in map(str.strip, _cut_at(text, "\n", False)):
        if len(line) < rules.shortest or rules.is_garbage(line):
            continue
        chapter = bool(rules.context.match(line))
        if rules.article.match(line):
            if article:
                yield whole()
            article, open_ = (" - ".join(context), [line]), True
        elif chapter or rules.is_title(line):
            open_ = False
            if chapter:
                context = [line]
            elif rules.titles and line not in context:
                context.append(line)
        elif open_:
            article[1].append(line)
    if article:
        yield whole()


def parse_statute(text: str | None, title: str, rules: StatuteRules) -> list[str]:
    """The texts of ``statute_articles`` in a list."""
    return list(statute_articles(text, title, rules))


def statute_rows(df: DataFrame, text: str, title: str, keep: list[str], rules: str = "strict", place: str = "article") -> DataFrame:
    """(keep, article, content): the articles of ``statute_column`` as rows, for texts of any length."""
    chosen = STATUTE_RULES[rules]
    return piece_rows(df, lambda x, name: statute_articles(x, name, chosen), [text, title], keep, place)


def statute_column(text: Column, title: Column, rules: str = "strict", whole: bool = False) -> Column:
    """Array of article texts. whole: a text without articles gives one element, the text itself."""
    chosen = STATUTE_RULES[rules]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([parse_statute(x, n, chosen) for x, n in zip(texts, titles, strict=True)])

    parsed = run(text, title)
    return F.when(F.size(parsed) == 0, F.array(F.concat(F.lit("Văn bản: "), title, F.lit("\n"), text))).otherwise(parsed) if whole else parsed
