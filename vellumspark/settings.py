"""Settings with explicit parameters; secrets are read from the environment only."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """What a retrieval and answering run needs; change a field with dataclasses.replace."""

    alpha: float = 0.5
    rrf_constant: int = 60
    k_stem: int = 8
    k_other: int = 12
    k1: float = 1.5
    b: float = 0.75
    chunk_size: int = 1024
    chunk_overlap: int = 200
    most_context: int = 37_500
    link_depth: int = 2
    chat_url: str | None = field(default_factory=lambda: os.environ.get("CHAT_URL"))
    chat_key: str | None = field(default_factory=lambda: os.environ.get("CHAT_KEY"), repr=False)

    def __post_init__(self):
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be within 0 and 1")

    def stats(self) -> dict[str, float]:
        return {"alpha": self.alpha, "rrf_constant": self.rrf_constant, "k_stem": self.k_stem, "k_other": self.k_other, "k1": self.k1, "b": self.b}
