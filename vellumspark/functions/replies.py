"""Tolerant reading of JSON replies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VERDICT = "safety string, domain string, refusal_status string"


def first_balanced(text: str | None) -> str | None:
    """The first {...} whose braces balance outside strings, None if there is none."""
    text = text or ""
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


@F.pandas_udf(StringType())
def balanced_json(texts: pd.Series) -> pd.Series:
    return texts.map(first_balanced)


def verdict(reply: Column) -> Column:
    """struct(safety, domain, refusal_status): whole reply, fenced part, balanced part, then single words; null without safety and domain."""

    def read(text: Column) -> Column:
        got = F.from_json(text, VERDICT)
        return F.when(got["safety"].isNotNull() & got["domain"].isNotNull(), got)

    upper = F.upper(F.coalesce(reply, F.lit("")))
    word = lambda pattern: F.nullif(F.regexp_extract(upper, pattern, 1), F.lit(""))
    safety, domain = word(r"\b(UNSAFE|SAFE)\b"), word(r"\b(STEM|LEGAL|SOCIAL)\b")
    words = F.struct(safety.alias("safety"), domain.alias("domain"), F.coalesce(word(r"\b(NO_INFO_VALID|TRAP_IGNORED|SAFETY_REFUSAL)\b"), F.lit("NONE")).alias("refusal_status"))
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(read(reply), read(fenced), read(balanced_json(reply)), F.when(safety.isNotNull() & domain.isNotNull(), words))
