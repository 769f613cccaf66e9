"""Embedding providers. A model is loaded once per Python worker, on first use."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class HashedBigrams:
    """Deterministic vectors from hashed character bigrams; stands in for a model in tests."""

    def __init__(self, size: int = 512):
        self.size, self.name = size, f"hashed-bigrams-{size}"

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            s = "".join((text or "").split()).lower()
            for k in range(max(1, len(s) - 1)):
                h = int.from_bytes(hashlib.blake2b(s[k : k + 2].encode(), digest_size=8).digest(), "big")
                row[h % self.size] += 1 if h >> 63 else -1
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)


def embedder(provider: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """A column function that embeds texts by Arrow batches; provider is picklable and may load lazily."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(provider(list(texts)), dtype=np.float32)))

    return embed
