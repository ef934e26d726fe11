"""Dense encoding of texts.

A model is supplied by the caller as an Arrow iterator function, so it is
loaded once per Python worker. The default encoder needs no model: it hashes
words into a fixed number of buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pandekt.functions.text import words
from pandekt.functions.vectors import l2_normalize

# Fixed value: instruction put before every text, question or passage alike.
INSTRUCTION_PREFIX = "Rappresenta questo testo legale italiano per il recupero: "

#: Words counted at once and words whose buckets are kept, by one Python worker.
RUN_WORDS, KEPT_WORDS = 1 << 20, 300_000

BatchEncoder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def hash_bucket(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim


def word_runs(lists: pa.Array, most: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of lists that hold ``most`` words together, or are one list, and ``rows`` lists at most."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        end = end if rows is None else min(end, at + rows)
        yield at, end
        at = end


def hashing_encoder(dim: int = 64):
    """Word lists to unit-length bucket-count vectors of ``dim`` entries.

    A batch is handled in runs of texts of about ``RUN_WORDS`` words: the distinct
    words of a run are hashed once and the counts of its texts come from one histogram.
    """
    def counted(lists: pa.Array, seen: dict[str, int]) -> np.ndarray:
        n = len(lists)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(lists.flatten())
        if len(seen) > KEPT_WORDS:
            seen.clear()
        bucket = np.array([seen[t] if t in seen else seen.setdefault(t, hash_bucket(t, dim)) for t in coded.dictionary.to_pylist()], dtype=np.int64)
        cell = np.repeat(np.arange(n), size) * dim + (bucket[coded.indices.to_numpy(zero_copy_only=False)] if len(bucket) else np.zeros(0, dtype=np.int64))
        return np.bincount(cell, minlength=n * dim).reshape(n, dim)

    @F.arrow_udf(ArrayType(DoubleType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict[str, int] = {}
        for batch in batches:
            n = len(batch)
            vec = np.zeros((n, dim))
            for at, end in word_runs(batch, RUN_WORDS):
                vec[at:end] = counted(batch.slice(at, end - at), seen)
            norm = np.sqrt((vec * vec).sum(axis=1, keepdims=True))
            vec = np.divide(vec, norm, out=vec, where=norm > 0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.array(vec.ravel()))
    return encode


def embed(df: DataFrame, text: str = "text", name: str = "vec", encoder: BatchEncoder | None = None,
          prefix: str = INSTRUCTION_PREFIX, dim: int = 64) -> DataFrame:
    """Add a unit-length vector column.

    ``encoder`` maps an iterator of text batches to an iterator of vector
    batches; its output is normalised here.
    """
    source: Column = F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))
    if encoder is None:
        return df.withColumn(name, hashing_encoder(dim)(words(source)))
    # Built as an untyped-hint UDF: the callable decides how it loads its model.
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from encoder(batches)
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    vectors = F.pandas_udf(run, ArrayType(DoubleType()))(source)
    return df.withColumn("_raw_vec", vectors).withColumn(name, l2_normalize(F.col("_raw_vec"))).drop("_raw_vec")
