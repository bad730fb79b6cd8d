"""Embedding and checks of stored vectors."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=50_000)
def _hashed(word: str) -> int:
    """Of the word's MD5 the first four bytes and, as the last bit, the next one's highest."""
    h = hashlib.md5(word.encode(), usedforsecurity=False).digest()
    return int.from_bytes(h[:4]) << 1 | h[4] >> 7


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed word hashes (MD5, which SQL engines have too), unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            words = np.array([_hashed(w) for w in (t or "").lower().split()], np.int64)
            out[i] = np.bincount((words >> 1) % dim, (words & 1) * 2 - 1, dim)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length == 0, 1, length)).tolist()

    return embed


def embed_texts(chunks: DataFrame, text_col: str = "embed_text", embed: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 20, max_retries: int = 5, partitions: int | None = None) -> DataFrame:
    """chunks with ``embedding``, from an injected batch function called for ``batch`` texts at a time, with retries.

    ``partitions`` bounds how many callers run at once. Persist the result before use: the calls are the cost.
    """
    fn = embed or hashing_embedder()

    def run(batches):
        for pdf in batches:
            vectors: list = []
            texts = pdf[text_col].tolist()
            for at in range(0, len(texts), batch):
                for attempt in range(max_retries):
                    try:
                        vectors += fn(texts[at : at + batch])
                        break
                    except Exception:
                        if attempt == max_retries - 1:
                            raise
            yield pdf.assign(embedding=pd.Series(vectors, index=pdf.index, dtype=object))

    source = chunks.coalesce(partitions) if partitions else chunks
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != "embedding")
    return source.drop("embedding").mapInPandas(run, f"{names}, embedding array<float>")


def bad_vectors(vectors: DataFrame, dim: int, id_col: str = "chunk_id", least: float = 1e-4) -> DataFrame:
    """Rows whose vector has another dimension or a length under ``least``: (id, dim, length)."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    out = vectors.select(id_col, F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim"), length.alias("length"))
    return out.where((F.col("dim") != dim) | F.col("length").isNull() | (F.col("length") < least))


def payload_mismatches(source: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields): rows on one side only (field ``<missing>`` or ``<extra>``) or with unequal fields; nulls equal nulls."""
    a, b = source.select(F.col(key).alias("k"), F.struct(*fields).alias("a")), stored.select(F.col(key).alias("k"), F.struct(*fields).alias("b"))
    both = a.join(b, "k", "full_outer")
    differ = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    bad = F.when(F.col("b").isNull(), F.array(F.lit("<missing>"))).when(F.col("a").isNull(), F.array(F.lit("<extra>"))).otherwise(differ)
    return both.select(F.col("k").alias(key), bad.alias("fields")).where(F.size("fields") > 0)
