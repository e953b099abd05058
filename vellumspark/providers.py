"""Chat and embedding providers. The offline ones are deterministic; HTTP is optional and reads its settings from the environment."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class OfflineChat:
    """Replies by rule: a routing prompt gets a JSON verdict, any other the option that shares most words with the rest."""

    def reply(self, system: str, user: str) -> str:
        if "JSON" in system:
            stem = bool(re.search(r"\$|\\frac|\d\s*[-+*/=]\s*\d", user))
            return json.dumps({"safety": "SAFE", "domain": "STEM" if stem else "SOCIAL", "refusal_status": "NONE"})
        options = re.findall(r"(?m)^([A-Z])\. (.+)$", user)
        words = set(re.findall(r"\w+", re.sub(r"(?m)^[A-Z]\. .+$", "", user).lower()))
        best = max(options, key=lambda o: len(words & set(re.findall(r"\w+", o[1].lower()))), default=("A", ""))
        return f"### ĐÁP ÁN: {best[0]}"


class FallbackChat:
    """The second provider answers what the first leaves empty."""

    def __init__(self, first, second):
        self.first, self.second = first, second

    def reply(self, system: str, user: str) -> str:
        return self.first.reply(system, user) or self.second.reply(system, user)


def linear_wait(attempt: int, jitter: float = 0.0) -> float:
    return 3.0 * (attempt + 1) + jitter


def growing_wait(attempt: int, base: float = 1.5) -> float:
    return base**attempt


class HttpChat:
    """A chat completion endpoint; retries with growing waits, then gives an empty reply."""

    def __init__(self, model: str, tries: int = 5, timeout: float = 60.0, jitter: float = 1.0):
        self.model, self.tries, self.timeout, self.jitter = model, tries, timeout, jitter

    def reply(self, system: str, user: str) -> str:
        body = {"model": self.model, "temperature": 0.1, "top_p": 0.95, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get('CHAT_KEY', '')}"}
        for attempt in range(self.tries):
            request = urllib.request.Request(os.environ["CHAT_URL"], json.dumps(body).encode(), headers)
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as got:
                    return json.load(got)["choices"][0]["message"]["content"] or ""
            except urllib.error.HTTPError as e:
                if e.code == 400:
                    return ""
            except OSError:
                pass
            time.sleep(linear_wait(attempt, random.uniform(0, self.jitter)))
        return ""


class HashedEmbedder:
    """Words hashed to signed dimensions: deterministic, no model. The places of the first ``most_held`` words are held, as common words come again."""

    def __init__(self, size: int = 64, most_held: int = 100_000):
        self.size, self.most_held = size, most_held
        self.held: dict[str, int] = {}

    def place(self, word: str) -> int:
        """The word's dimension; that of positive ones plus ``size``."""
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        at = h % self.size + (self.size if h >> 63 else 0)
        if len(self.held) < self.most_held:
            self.held[word] = at
        return at

    def embed(self, text: str) -> list[float]:
        held = self.held
        places = [at if (at := held.get(word)) is not None else self.place(word) for word in re.findall(r"\w+", text.lower())]
        n = np.bincount(np.array(places, np.int64), minlength=2 * self.size)
        return (n[self.size :] - n[: self.size]).astype(np.float32).tolist()


class HttpEmbedder:
    """An embedding endpoint: one try; errors are raised."""

    def __init__(self, model: str, timeout: float = 30.0):
        self.model, self.timeout = model, timeout

    def embed(self, text: str) -> list[float]:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get('EMBED_KEY', '')}"}
        request = urllib.request.Request(os.environ["EMBED_URL"], json.dumps({"model": self.model, "input": text}).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as got:
            return json.load(got)["data"][0]["embedding"]


class Retrying:
    """An embedder that is asked again after an error, with growing waits; None after the last try."""

    def __init__(self, embedder, tries: int = 3, wait=growing_wait):
        self.embedder, self.tries, self.wait = embedder, tries, wait

    def embed(self, text: str) -> list[float] | None:
        for attempt in range(self.tries):
            try:
                return self.embedder.embed(text)
            except (OSError, ValueError, KeyError, IndexError):
                if attempt + 1 < self.tries:
                    time.sleep(self.wait(attempt))
        return None


class TokenBucket:
    """At most ``rate`` calls in ``seconds``, shared out over ``tasks`` concurrent tasks."""

    def __init__(self, rate: float, seconds: float, tasks: int = 1):
        self.gap, self.next = seconds / max(rate / max(tasks, 1), 1e-9), 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def ask(df: DataFrame, provider, system_col: str, user_col: str, out: str, bucket: TokenBucket | None = None, at_once: int = 1) -> DataFrame:
    """df with the provider's reply added, at most ``at_once`` calls of a task open. Store the result before it is used twice: a call is never free."""

    def one(pair: tuple[str | None, str | None]) -> str:
        return provider.reply(pair[0] or "", pair[1] or "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                replies = []
                for pair in zip(frame[system_col], frame[user_col], strict=True):
                    if bucket:
                        bucket.wait()
                    replies.append(pool.submit(one, pair) if at_once > 1 else one(pair))
                frame[out] = [r.result() for r in replies] if at_once > 1 else replies
                yield frame

    return df.mapInPandas(run, ", ".join(f"`{n}` {k}" for n, k in [*df.dtypes, (out, "string")]))


def embed(df: DataFrame, provider, text_col: str, out: str = "vector") -> DataFrame:
    """df with the vectors of a text column. Only that column goes to Python; the function is called non-deterministic so that no text is sent twice for one row."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([provider.embed(x or "") for x in texts], index=texts.index, dtype=object)

    return df.select("*", run.asNondeterministic()(F.col(text_col)).alias(out))
