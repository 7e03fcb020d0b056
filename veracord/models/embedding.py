"""Embeddings: a deterministic bag-of-words model, and the columns that hold embeddings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
EMBEDDING, SENTENCES = "{}_embedding", "{}_sentence_embeddings"


def sentences(text: str | None) -> list[str]:
    return [s for s in SENTENCE_END.split(text or "") if s.strip()]


@dataclass(frozen=True)
class HashEmbedder:
    """Unit vector of word counts over md5 buckets; the zero vector for a text without words."""

    dimensions: int = 64

    def embed(self, text: str | None) -> list[float]:
        v = [0.0] * self.dimensions
        for w in re.findall(r"\w+", (text or "").lower()):
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dimensions] += 1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]

    def embed_batch(self, texts: list[str | None]) -> list[list[float]]:
        return [self.embed(t) for t in texts]

    def embed_with_sentences(self, texts: list[str | None]) -> list[tuple[list[float], list[list[float]]]]:
        return [(self.embed(t), [self.embed(s) for s in sentences(t)]) for t in texts]


def add_embeddings(df: DataFrame, column: str, embedder: HashEmbedder | None = None) -> DataFrame:
    """``df`` with the column's embedding and those of its sentences, one pass in Arrow batches."""
    model = embedder or HashEmbedder()

    @F.pandas_udf("whole array<float>, parts array<array<float>>")
    def embed(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            got = model.embed_with_sentences(texts.tolist())
            yield pd.DataFrame({"whole": [a for a, _ in got], "parts": [b for _, b in got]})

    both = df.withColumn("__embedded", embed.asNondeterministic()(F.col(column)))
    return both.select(*df.columns, F.col("__embedded.whole").alias(EMBEDDING.format(column)), F.col("__embedded.parts").alias(SENTENCES.format(column)))
