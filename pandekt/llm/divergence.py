"""How far the sources of a language differ in their terms, exactly.

Counts of kept terms are leaves of one segment tree per (lang, source) group,
over term ids in byte order. Trees are cut into blocks of BLOCK_TERMS ids, which
different tasks hold; inside a block nodes are hash-consed over all its groups:
a node is named by the names of its two children, so equal subtrees are one
node. Two groups are compared by walking their trees at the same time, level by
level. A pair of nodes that turns up again in the same two groups is priced
once and its price is shared on the way back up. Spark adds the blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pandekt.llm.common import bytes_of, cut, released, small_batches
from pandekt.llm.terms import LETTERS, term_lists
from pandekt.operators.ordered import row_positions

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
#: Term ids of a block and groups of a block of groups: a task holds at most 2 * BLOCK_GROUPS * BLOCK_TERMS counts.
BLOCK_TERMS = 4096
BLOCK_GROUPS = 64
#: Ids of a larger language are given in ranges by several tasks.
RANGE_ROWS = 4096
#: Counts a worker adds up before it hands them on.
HELD = 300_000
#: Pairs of groups walked at a time.
WALKED = 64


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up by worker as far as HELD entries go."""
    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def emit(held: dict) -> pa.RecordBatch:
        langs, sources, terms, n, d = [], [], [], [], []
        for (la, so), (count, seen) in held.items():
            langs.extend([la] * len(count))
            sources.extend([so] * len(count))
            terms.extend(count)
            n.extend(count.values())
            d.extend(map(seen.__getitem__, count))
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                                           pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import _count_elements as count_up

        held: dict = defaultdict(lambda: ({}, {}))
        size = 0
        for batch in batches:
            for la, so, t in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), bytes_of(batch.column("text")), strict=True):
                count, seen = held[la, so]
                size -= len(count)
                own: set = set()
                for words in term_lists(t, LETTERS):
                    count_up(count, words)
                    own.update(words)
                count_up(seen, own)
                size += len(count)
                if size > HELD:
                    yield emit(held)
                    held.clear()
                    size = 0
        if size:
            yield emit(held)

    return src.mapInArrow(released(run), "lang string, source string, term string, n long, docs long")


def _p(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / whole), in decimals: exact at any count."""
    wide = lambda c: c.cast("decimal(25,0)")
    top = (F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(SMOOTHING).cast("decimal(10,0)"))).cast("decimal(38,0)")
    # The product is a whole number and so is the quotient's floor: div drops the fraction of non-negative numbers.
    return F.lit(1).cast("long") + F.call_function("div", top, whole.cast("decimal(38,0)"))


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same for arrays. Products beyond 64 bits are made with whole numbers of any size."""
    if len(count) and int(count.max()) >= (1 << 63) // SCALE - SMOOTHING - 1:
        return np.array([1 + SCALE * (int(c) + SMOOTHING) // int(w) for c, w in zip(count, whole, strict=True)], dtype=np.int64)
    return 1 + SCALE * (count + SMOOTHING) // whole


class Forest:
    """Hash-consed segment trees of equal width, one per row of ``counts``. A count of -1 is padding and costs nothing."""

    def __init__(self, counts: np.ndarray) -> None:
        width = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        if width > counts.shape[1]:
            counts = np.pad(counts, ((0, 0), (0, width - counts.shape[1])), constant_values=-1)
        self.leaves, names = np.unique(counts, return_inverse=True)
        names = names.reshape(counts.shape)
        #: Per level above the leaves: names of the left and right child of every node.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        below = len(self.leaves)
        while names.shape[1] > 1:
            nodes, inverse = np.unique(names[:, ::2] * below + names[:, 1::2], return_inverse=True)
            self.levels.append((nodes // below, nodes % below))
            below = len(nodes)
            names = inverse.reshape(len(counts), -1)
        self.roots = names[:, 0]

    def distances(self, first: np.ndarray, second: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Sum of |share - share| over the leaves for pairs of rows; ``whole`` is every row's denominator."""
        pair = np.arange(len(first))
        a, b = self.roots[first], self.roots[second]
        back = []
        for left, right in reversed(self.levels):
            n = len(left)
            key, inverse = np.unique((pair * n + a) * n + b, return_inverse=True)
            back.append(inverse)
            b, rest = key % n, key // n
            a, pair = rest % n, rest // n
            a, b, pair = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]]), np.concatenate([pair, pair])
        n = len(self.leaves)
        key, inverse = np.unique((pair * n + a) * n + b, return_inverse=True)
        ca, cb, pair = self.leaves[key // n % n], self.leaves[key % n], key // n // n
        price = np.abs(shares(ca, whole[first[pair]]) - shares(cb, whole[second[pair]]))
        price[ca < 0] = 0
        price = price[inverse]
        for inverse in reversed(back):
            half = len(price) // 2
            price = (price[:half] + price[half:])[inverse]
        return price


def _block_distances(key: tuple, rows: pa.Table) -> pa.Table:
    """Distances of one block of term ids between the groups of one or two blocks of groups."""
    lang, _, bi, bj = (k.as_py() for k in key)
    size = rows.column("size")[0].as_py()
    gid, whole, part = (rows.column(c).to_numpy() for c in ("gid", "whole", "gblock"))
    counts = np.zeros((len(gid), max(size, 1)), dtype=np.int64)
    if not size:
        counts[:] = -1
    for i, (at, n) in enumerate(zip(rows.column("at").to_pylist(), rows.column("n").to_pylist(), strict=True)):
        if at:
            counts[i, at] = n
    forest = Forest(counts)
    first, second = np.flatnonzero(part == bi), np.flatnonzero(part == bj)
    x, y = np.repeat(first, len(second)), np.tile(second, len(first))
    wanted = gid[x] < gid[y] if bi == bj else np.ones(len(x), dtype=bool)
    x, y = x[wanted], y[wanted]
    out = np.concatenate([np.zeros(0, dtype=np.int64), *[forest.distances(x[k:k + WALKED], y[k:k + WALKED], whole) for k in range(0, len(x), WALKED)]])
    return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "g": pa.array(gid[x]), "h": pa.array(gid[y]), "cost": pa.array(out)})


def group_distances(counts: DataFrame, groups: DataFrame, block_terms: int = BLOCK_TERMS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """(lang, g, h, cost) for every two groups g < h of a language.

    ``counts`` has lang, gid, tid (both from 1) and n; ``groups`` has lang, gid,
    whole (the denominator), sources (groups of the language) and kept (its terms).
    """
    gb = lambda c: F.floor((F.col(c) - 1) / block_groups).cast("long")
    tb = F.floor((F.col("tid") - 1) / block_terms).cast("long")
    lists = counts.select("lang", "gid", tb.alias("tblock"), ((F.col("tid") - 1) % block_terms).cast("int").alias("at"), "n").groupBy("lang", "gid", "tblock").agg(
        F.collect_list(F.struct("at", "n")).alias("cells"))
    # A group has a row for every block, filled or not.
    last = F.greatest(F.ceil(F.col("kept") / block_terms), F.lit(1)).cast("long") - 1
    heads = groups.withColumn("tblock", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(
        "size", F.least(F.lit(block_terms).cast("long"), F.col("kept") - F.col("tblock") * block_terms))
    rows = heads.join(lists, ["lang", "gid", "tblock"], "left").select(
        "lang", "tblock", "gid", "whole", "size", gb("gid").alias("gblock"), F.col("cells.at").alias("at"), F.col("cells.n").alias("n"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / block_groups).cast("long"))).alias("other"))
    rows = rows.withColumn("bi", F.least("gblock", "other")).withColumn("bj", F.greatest("gblock", "other")).drop("other")
    costs = rows.groupBy("lang", "tblock", "bi", "bj").applyInArrow(_block_distances, "lang string, g long, h long, cost long")
    return costs.groupBy("lang", "g", "h").agg(F.sum("cost").alias("cost"))


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Distances between sources and the terms a source uses more than its language.

    Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; a
    language keeps those in at least ``min_docs`` of its rows (a repeated row or
    id counts again). With N occurrences of kept terms in a group and V kept
    terms, p = 1 + floor(1e9 * (count + 5) / (N + 5 V)).

    Returns lang, source, part, item, value, rank. Part ``pair``: every other
    source of the language with the sum of |p - q| over kept terms. Part
    ``term``: the ``top`` kept terms of the group with the largest p - q above 0,
    q being the language's. Larger values come first, then items in byte order.
    Null text, lang and source are ''. A language without kept terms has
    distances of 0, a group without terms has all pairs and no terms, an empty
    table has no rows. Columns not named are left out.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    rows = term_counts(docs, lang, source, text).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = rows.withColumn("seen", F.sum("docs").over(Window.partitionBy("lang", "term"))).filter(F.col("seen") >= min_docs)
    kept = cut(rows.select("lang", "source", "term", "n"), "term-counts")
    terms = cut(row_positions(kept.groupBy("lang", "term").agg(F.sum("n").alias("total")), ["lang"], ["term"], "tid", RANGE_ROWS, 16 * RANGE_ROWS), "terms")
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("all_n"))
    known = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["group_n", "kept", "all_n"])
    known = known.join(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "lang")
    smooth = F.col("kept") * SMOOTHING
    known = cut(row_positions(known.withColumn("whole", F.col("group_n") + smooth).withColumn("all_whole", F.col("all_n") + smooth), ["lang"], ["source"], "gid", RANGE_ROWS, 16 * RANGE_ROWS), "groups")
    cells = kept.join(known.select("lang", "source", "gid", "whole", "all_whole"), ["lang", "source"]).join(terms, ["lang", "term"])
    costs = group_distances(cells.select("lang", "gid", "tid", "n"), known.select("lang", "gid", "whole", "sources", "kept"))
    costs = costs.select("lang", F.explode(F.array(F.struct(F.col("g").alias("gid"), F.col("h").alias("other")), F.struct(F.col("h").alias("gid"), F.col("g").alias("other")))).alias("x"), "cost").select("lang", "x.*", "cost")
    names = known.select("lang", "gid", "source")
    pairs = costs.join(names, ["lang", "gid"]).join(names.select("lang", F.col("gid").alias("other"), F.col("source").alias("item")), ["lang", "other"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.col("cost").alias("value"))
    excess = _p(F.col("n"), F.col("whole")) - _p(F.col("total"), F.col("all_whole"))
    words = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value")).filter("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(words.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))
