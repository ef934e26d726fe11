"""Vector columns as arrays: which take part, and distinct ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def usable(embedding: Column) -> Column:
    """Not null, not empty, only finite components, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, bad) & F.exists(embedding, lambda x: x != 0)


def clean_zero(embedding: Column) -> Column:
    """Doubles, with -0.0 as 0.0, so that equal vectors have equal bytes."""
    return F.transform(embedding, lambda x: x.cast("double") + F.lit(0.0))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of equal length from a list column without nulls; raises where lengths differ."""
    lengths = pc.list_value_length(column)
    if len(column) and pc.min(lengths) != pc.max(lengths):
        raise ValueError(f"vectors of {pc.min(lengths)} and {pc.max(lengths)} components in one table")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False) if len(column) else np.zeros((0, 0), dtype=dtype)


def require_one_length(rows: DataFrame, vec: str = "vec") -> None:
    """Raise unless all vectors of a table have one length: a cosine needs equal lengths."""
    low, high = rows.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} components in one table")


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Rows are scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """One row per label and distinct vector: label, vec, node (a hash of both), least (its smallest id) and copies.

    ``rows`` has label, vec_id and vec (clean doubles). Map tasks combine copies first.
    """
    return rows.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.xxhash64("label", "vec"))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: dot / (|a| |b|) in double precision. Extreme values are scaled first."""
    sa, sb = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    if len(a) and (max(sa.max(), sb.max()) > 1e100 or min(sa.min(), sb.min()) < 1e-100):
        a, b = a / sa, b / sb
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
