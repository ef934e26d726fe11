"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pandekt.llm.common import cut, partitions


#: Links that one task settles: 16 MB.
SMALL = 1 << 20


def union_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of a small set of links held in memory."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _shrink(edges: DataFrame, cap: int = 1 << 20) -> DataFrame:
    """Replace the links of each partition by stars: at most one row per node and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def close() -> pa.RecordBatch:
            a = np.concatenate([x for x, _ in held])
            b = np.concatenate([y for _, y in held])
            nodes, roots = union_roots(a, b)
            move = nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(nodes[move]), pa.array(roots[move])], names=["u", "v"])

        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            rows += batch.num_rows
            if rows >= cap:
                yield close()
                held, rows = [], 0
        if rows:
            yield close()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _finish(edges: DataFrame) -> DataFrame:
    """Components of a counted, small number of links by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if held:
            nodes, roots = union_roots(np.concatenate([u for u, _ in held]), np.concatenate([v for _, v in held]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "component"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, rounds: int = 40, small: int = SMALL) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    At most ``small`` links (counted after the first contraction) are settled by
    one task at once; more go through rounds. Both give the same rows.

    Each round links every larger neighbour of a node to the smallest known node
    around it, then every node to the smallest of its smaller neighbours. The
    least labels per node are written before they are joined, so that a node
    with very many links is split by the skew join. Ends when nothing changes,
    after about log(n) rounds.
    """
    spark = edges.sparkSession
    e = cut(_shrink(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")), "links")
    if e.count() <= small:
        return _finish(e)
    mark = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = cut(_shrink(large.repartition(partitions(spark), "u")), "large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u")
        e = cut(_shrink(small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()), "links")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components didn't settle")
    # Every node now points to its root, roots point to nothing.
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
