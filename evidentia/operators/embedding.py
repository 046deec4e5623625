"""Embeddings through a pluggable provider, one Arrow batch at a time."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Embedder(Protocol):
    """Turns texts into vectors, one per text, in the same order."""

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Seeded feature hashing of words, scaled to length one. Needs no model and no network."""

    def __init__(self, dimensions: int = 64, seed: int = 0):
        self.dimensions, self.seed = dimensions, seed

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        words = [re.findall(r"[0-9a-z]+|[\u4e00-\u9fff]", (text or "").lower()) for text in texts]
        codes = np.array([zlib.crc32(word.encode(), self.seed) for own in words for word in own], dtype=np.int64)
        places = np.repeat(np.arange(len(texts)) * self.dimensions, [len(own) for own in words]) + codes % self.dimensions
        signs = np.where(codes & 0x80000000, 1.0, -1.0)
        # Sums of whole numbers: exact in any order.
        out = np.bincount(places, weights=signs, minlength=len(texts) * self.dimensions).astype(float).reshape(len(texts), self.dimensions)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def embed(
    df: DataFrame, text: str, provider: Callable[[], Embedder] = HashingEmbedder,
    out: str = "embedding", batch_size: int = 32,
) -> DataFrame:
    """Adds ``out`` (array<float>). ``provider`` is called once per Python worker task."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for texts in batches:
            values = texts.tolist()
            parts = [
                row.astype("float32")
                for start in range(0, len(values), batch_size)
                for row in model.embed(values[start : start + batch_size])
            ]
            yield pd.Series(parts, index=texts.index, dtype=object)

    return df.withColumn(out, vectors(F.col(text)))
