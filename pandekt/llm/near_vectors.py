"""Near-duplicate vectors by neighbour-graph descent.

Equal vectors are one node. Nodes of one label are compared in blocks of random
projection trees, then by descent: in each round a node gathers its neighbours
and reverse neighbours and compares them with each other. Every pair found at
or above the threshold ties two components at once, in a link table of its own
that no list trims; what a block ties is written as one row per component, so
pairs are never emitted. A node keeps two lists: its nearest known nodes inside
its component and the nearest outside. A saturated list is enlarged by that: its
component counts as listed as a whole, and the list outside looks past it. Rounds
go on until no component grows. Links are then counted over all pairs of
members of a component, block by block. An audit compares a fixed number of
nodes of every size of component with all vectors and judges, for every number
of links, the share of nodes whose links are complete. Another forest and
rounds follow until each share is reached; if none helps, the operator raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pandekt.llm.common import cut, partitions
from pandekt.llm.components import components
from pandekt.llm.vectors import clean_zero, distinct_vectors, exact_cosine, matrix, require_one_length, unit_rows, usable

THRESHOLD = 0.98
LIST = 8
TREES = 8
LEAF = 48
BLOCK = 512
AUDIT = 256
RECALL = 0.95
#: Share of pairs at the threshold that all trees together may part before the descent.
MISS = 1e-3
AUDIT_ROWS = 1024
#: Nodes without a component, where lost pairs hide, are compared in so many times the number.
ALONE = 8
#: Distance to the threshold within which the fast comparison is repeated in the exact order of the definition.
SLACK = 1e-4


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return unit_rows(a) @ unit_rows(b).T


def _linked(a: np.ndarray, b: np.ndarray, s: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines ``s`` of the rows of a and b reach the threshold; those near it are compared again exactly."""
    linked = s >= threshold
    r, c = np.nonzero(np.abs(s - threshold) < SLACK)
    linked[r, c] = exact_cosine(a[r], b[c]) >= threshold
    return linked


def _smallest(tied: np.ndarray) -> np.ndarray:
    """Smallest row reachable from every row of a symmetric matrix of ties."""
    n = len(tied)
    tied = tied | np.eye(n, dtype=bool)
    root = np.arange(n)
    while True:
        low = np.where(tied, root, n).min(axis=1)
        low = low[low]
        if (low == root).all():
            return root
        root = low


#: Rows with ``tie`` name two components that are one; the others are list entries.
PAIRS = "label long, u long, v long, sim double, tie boolean"


def _compared(label: int, node: np.ndarray, comp: np.ndarray, x: np.ndarray, floors: tuple[np.ndarray, np.ndarray], k: int, threshold: float) -> pa.RecordBatch:
    """All pairs of a block: its ties, and of every node the k best inside and outside its component above their floors."""
    s = _cosines(x, x)
    roots = _smallest(_linked(x, x, s, threshold) | (comp[:, None] == comp))
    u, v = comp, comp[roots]
    ties = np.unique(np.stack([u, v], axis=1)[u != v], axis=0)
    out = [(ties[:, 0], ties[:, 1], np.ones(len(ties)))]
    inside = roots[:, None] == roots
    np.fill_diagonal(s, -3.0)
    top = min(k, len(node) - 1)
    for pick, floor in ((inside, floors[0]), (~inside, floors[1])):
        sims = np.where(pick & (s > floor[:, None]), s, -3.0)
        best = np.argpartition(-sims, top - 1, axis=1)[:, :top]
        rows, cols = np.repeat(np.arange(len(node)), top), best.ravel()
        keep = sims[rows, cols] > -2.5
        rows, cols = rows[keep], cols[keep]
        out.append((node[rows], node[cols], s[rows, cols]))
    sizes = [len(o[0]) for o in out]
    u, v, sim = (np.concatenate([o[i] for o in out]) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), label, dtype=np.int64)), pa.array(u), pa.array(v), pa.array(sim), pa.array(np.arange(len(u)) < sizes[0])], names=["label", "u", "v", "sim", "tie"])


def _trees(depth: int, threshold: float, least: int = TREES) -> int:
    """Trees of that depth that together part at most MISS of the pairs at the threshold: a plane parts arccos(threshold) / pi of them."""
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** depth
    return least if together >= 1 else max(least, int(np.ceil(np.log(MISS) / np.log1p(-together))))


def _depths(nodes: DataFrame) -> DataFrame:
    """(label, depth): planes that a label needs for leaves of about LEAF rows."""
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("label", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF))).cast("int").alias("depth"))


def _forest(nodes: DataFrame, first_tree: int, trees: int, k: int, threshold: float) -> DataFrame:
    """Ties and neighbours inside leaves of random projection trees.

    A node's leaf is given by the signs of as many random projections as its
    label needs for leaves of about LEAF rows. Leaves are read in order of one
    more projection and cut to blocks of BLOCK rows.
    """
    spark = nodes.sparkSession
    planned = nodes.join(_depths(nodes), "label")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(matrix(batch.column("vec")))
            depths = batch.column("depth").to_numpy()
            for tree in range(first_tree, first_tree + trees):
                planes = np.random.default_rng(1000 + tree).standard_normal((x.shape[1], 32))
                y = x @ planes
                bits = (y[:, 1:] > 0) << np.arange(31)
                mask = (np.int64(1) << depths.astype(np.int64)) - 1
                leaf = bits.sum(axis=1) & mask
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array([tree] * batch.num_rows, pa.int32()), pa.array(leaf.astype(np.int64)), pa.array(y[:, 0]), batch.column("node"), batch.column("comp"), batch.column("vec")],
                    names=["label", "tree", "leaf", "at", "node", "comp", "vec"])

    planted = planned.select("label", "depth", "node", "comp", "vec").mapInArrow(plant, "label long, tree int, leaf long, at double, node long, comp long, vec array<double>")
    # Ranges, not hashes: a full leaf is spread over tasks.
    ordered = planted.repartitionByRange(partitions(spark), "label", "tree", "leaf", "at", "node").sortWithinPartitions("label", "tree", "leaf", "at", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, comps, vecs = None, [], [], []

        def close():
            if len(ids) < 2:
                return None
            free = np.full(len(ids), -2.0)
            return _compared(key[0], np.array(ids, dtype=np.int64), np.array(comps, dtype=np.int64), np.concatenate(vecs), (free, free), k, threshold)

        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"))
            cols = [batch.column(c).to_pylist() for c in ("label", "tree", "leaf", "node", "comp")]
            for i, (label, tree, leaf, node, comp) in enumerate(zip(*cols, strict=True)):
                if (label, tree, leaf) != key or len(ids) >= BLOCK:
                    if (out := close()) is not None:
                        yield out
                    key, ids, comps, vecs = (label, tree, leaf), [], [], []
                ids.append(node)
                comps.append(comp)
                vecs.append(x[i:i + 1])
        if key is not None and (out := close()) is not None:
            yield out

    return ordered.mapInArrow(compare, PAIRS)


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of every node inside its component, and as many outside."""
    w = Window.partitionBy("u", "inside").orderBy(F.desc("sim"), "v")
    return pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _best(pairs: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """Lists of distinct neighbours by the components of ``placed``."""
    one = pairs.groupBy("label", "u", "v").agg(F.max("sim").alias("sim"))
    comp = lambda n: placed.select(F.col("node").alias(n), F.col("comp").alias(f"{n}_comp"))
    told = one.join(comp("u"), "u").join(comp("v"), "v")
    return _nearest(told.select("label", "u", "v", "sim", (F.col("u_comp") == F.col("v_comp")).alias("inside")), k)


def _descend(lists: DataFrame, placed: DataFrame, k: int, threshold: float) -> DataFrame:
    """One round: neighbours and reverse neighbours of a node are compared with each other.

    Of the reverse neighbours the k nearest inside and outside take part, as many
    as the lists hold: those of a crowded node meet again in the block comparison
    of its component.
    """
    spark = lists.sparkSession
    floor = lambda side: F.when(F.count_if(side) >= k, F.min(F.when(side, F.col("sim")))).otherwise(F.lit(-2.0))
    floors = lists.groupBy(F.col("u").alias("node")).agg(floor(F.col("inside")).alias("floor_in"), floor(~F.col("inside")).alias("floor_out"))
    back = _nearest(lists.select("label", F.col("v").alias("u"), F.col("u").alias("v"), "sim", "inside"), k)
    around = lists.select("label", "u", "v").union(back.select("label", "u", "v")).distinct()
    carried = placed.select("node", "comp", "vec").join(floors, "node", "left").select(
        F.col("node").alias("v"), "comp", "vec", F.coalesce("floor_in", F.lit(-2.0)).alias("floor_in"), F.coalesce("floor_out", F.lit(-2.0)).alias("floor_out"))
    gathered = around.join(carried, "v").repartition(partitions(spark), "u").sortWithinPartitions("u", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close():
            if len(held) < 2:
                return None
            node, comp = (np.array([h[i] for h in held], dtype=np.int64) for i in (0, 1))
            floors = tuple(np.array([h[i] for h in held]) for i in (2, 3))
            return _compared(key[0], node, comp, np.concatenate([h[4] for h in held]), floors, k, threshold)

        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"))
            for i, (label, u, *v) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", "u", "v", "comp", "floor_in", "floor_out")), strict=True)):
                if (label, u) != key:
                    if (out := close()) is not None:
                        yield out
                    key, held = (label, u), []
                held.append((*v, x[i:i + 1]))
        if (out := close()) is not None:
            yield out

    return gathered.select("label", "u", "v", "comp", "floor_in", "floor_out", "vec").mapInArrow(meet, PAIRS)


def _placed(nodes: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Nodes with the component they are in: itself where nothing is tied to them."""
    if parts is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(parts, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _pairs(known: DataFrame | None, found: DataFrame) -> DataFrame:
    fresh = found.filter("NOT tie").select("label", "u", "v", "sim")
    return fresh if known is None else known.union(fresh)


def _grown(parts: DataFrame | None, found: DataFrame) -> tuple[DataFrame, bool]:
    """(components with the ties of ``found``, whether there were any)."""
    ties = found.filter("tie").select("u", "v").distinct()
    grows = bool(ties.take(1))
    if parts is not None and not grows:
        return parts, False
    links = ties if parts is None else ties.union(parts.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return cut(components(links), "parts"), grows


def _blocks(nodes: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(node, linked): links of every node inside its component, from all pairs of blocks of its members."""
    spark = nodes.sparkSession
    member = nodes.join(parts, "node")
    load = cut(member.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("c")), "load")
    placed = member.join(load, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("c")))
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1), lambda q: F.least(q, F.col("part")) * F.col("c") + F.greatest(q, F.col("part"))))
    dealt = placed.select("component", pair.alias("pair"), "c", "part", "node", "copies", "vec").repartition(partitions(spark), "component", "pair").sortWithinPartitions("component", "pair", "part", "node")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close():
            i, j = divmod(key[1], held[0][0])
            side = lambda p: [h for h in held if h[1] == p]
            left, right = side(i), side(j)
            if not left or not right:
                return None
            a, b = (np.concatenate([h[4] for h in s]) for s in (left, right))
            linked = _linked(a, b, _cosines(a, b), threshold)
            if i == j:
                np.fill_diagonal(linked, False)
            wa, wb = (np.array([h[3] for h in s], dtype=np.int64) for s in (left, right))
            out = [(np.array([h[2] for h in left], dtype=np.int64), linked @ wb)]
            if i != j:
                out.append((np.array([h[2] for h in right], dtype=np.int64), wa @ linked))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([y for _, y in out]).astype(np.int64))], names=["node", "linked"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"))
            for i, (component, pair_no, c, part, node, copies) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("component", "pair", "c", "part", "node", "copies")), strict=True)):
                if (component, pair_no) != key:
                    if key is not None and (out := close()) is not None:
                        yield out
                    key, held = (component, pair_no), []
                held.append((c, part, node, copies, x[i:i + 1]))
        if key is not None and (out := close()) is not None:
            yield out

    return dealt.mapInArrow(count, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def audit(nodes: DataFrame, counted: DataFrame, threshold: float, size: int = AUDIT) -> list[tuple[int, int, float]]:
    """(links of a node at least, nodes compared, share of them whose links are complete), by powers of two of the links there are.

    Up to ``size`` nodes of every size of component (powers of two), and ALONE
    times as many without one, chosen by a hash of their id, are compared with all
    vectors. A node counts for as many as it was chosen from; nodes without a link
    to another vector don't count. So neither large groups nor many copies outweigh small ones.
    ``counted`` has node, component and linked.
    """
    sizes = counted.groupBy("component").agg(F.floor(F.log2(F.count(F.lit(1)))).cast("int").alias("stratum"))
    own = nodes.join(counted.join(sizes, "component").select("node", "linked", "stratum"), "node", "left").select(
        "node", F.coalesce("linked", F.lit(0).cast("long")).alias("linked"), F.coalesce("stratum", F.lit(-1)).alias("stratum"))
    rows_of = dict(own.groupBy("stratum").count().collect())
    # Hashes drop most of a large stratum where it lies: the ranking reads a few times what it chooses, at any size.
    want = F.when(F.col("stratum") < 0, ALONE * size).otherwise(size)
    drawn = [(F.col("stratum") == k) & (F.pmod(F.xxhash64("node", F.lit(9)), F.lit(n)) < 2 * size * (ALONE if k < 0 else 1) + 100) for k, n in rows_of.items()]
    w = Window.partitionBy("stratum").orderBy(F.xxhash64("node"), "node")
    few = own.filter(reduce(or_, drawn, F.lit(False))).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= want).drop("_r")
    chosen = few.join(nodes.select("node", "label", "vec"), "node").toArrow().combine_chunks()
    if not chosen.num_rows:
        return []
    ids, labels, strata, linked = (chosen.column(c).to_numpy() for c in ("node", "label", "stratum", "linked"))
    x = matrix(chosen.column("vec").combine_chunks())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, nodes_of = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, AUDIT_ROWS):
                batch = whole.slice(at, AUDIT_ROWS)
                v, node, label, copies = matrix(batch.column("vec")), *(batch.column(c).to_numpy() for c in ("node", "label", "copies"))
                for one in np.unique(label).tolist():
                    mine, theirs = np.flatnonzero(labels == one), np.flatnonzero(label == one)
                    if len(mine):
                        s = _linked(v[theirs], x[mine], _cosines(v[theirs], x[mine]), threshold) & (node[theirs][:, None] != ids[mine])
                        total[mine] += copies[theirs] @ s
                        nodes_of[mine] += s.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total), pa.array(nodes_of)], names=["node", "there", "others"])

    there = nodes.select("label", "node", "copies", "vec").mapInArrow(count, "node long, there long, others long").groupBy("node").agg(F.sum("there"), F.sum("others"))
    truth = {r[0]: (r[1], r[2]) for r in there.collect()}
    links, others = (np.array([truth[i][k] for i in ids.tolist()], dtype=np.int64) for k in (0, 1))
    weight = np.array([rows_of[k] / (strata == k).sum() for k in strata.tolist()])
    bucket = np.floor(np.log2(np.maximum(others, 1))).astype(np.int64)
    out = []
    for b in np.unique(bucket[others > 0]).tolist():
        mine = (bucket == b) & (others > 0)
        out.append((1 << b, int(mine.sum()), float(weight[mine & (linked == links)].sum() / weight[mine].sum())))
    return out


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
                 list_size: int = LIST, trees: int = TREES, rounds: int = 2, recall: float = RECALL, max_forests: int = 4) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Two vectors link when their labels are equal and not null and the cosine is
    at least ``threshold``. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null label or id, link with nothing.
    Equal vectors of one label are linked copies. Vectors of different length in one
    table raise. Rows that repeat an id
    count as vectors of their own. Other columns are ignored. An empty table
    gives no rows. ``trees`` is the least number of trees of a forest, more follow
    from the depth they need. Raises when the audit finds a share of nodes with
    complete links below ``recall`` after ``max_forests`` forests.
    """
    spark = rows.sparkSession
    src = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("vec"))
    ok = usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    clean = src.filter(ok).select("vec_id", "label", clean_zero(F.col("vec")).alias("vec"))
    nodes = cut(distinct_vectors(clean), "nodes")
    require_one_length(nodes)
    trees = _trees(_depths(nodes).agg(F.max("depth")).first()[0] or 0, threshold, trees)
    known = parts = None
    for forest in range(max_forests):
        found = cut(_forest(_placed(nodes, parts), forest * trees, trees, list_size, threshold), "found")
        parts, _ = _grown(parts, found)
        done, grows = 0, True
        # A list is saturated as long as something found beyond it joins its component.
        while done < rounds or grows:
            known = _pairs(known, found)
            placed = cut(_placed(nodes, parts), "placed")
            lists = cut(_best(known, placed, list_size), "lists")
            known = lists.select("label", "u", "v", "sim")
            found = cut(_descend(lists, placed, list_size, threshold), "found")
            parts, grows = _grown(parts, found)
            done += 1
        known = _pairs(known, found)
        counted = cut(_blocks(nodes, parts, threshold), "counted")
        shares = audit(nodes, counted.join(parts, "node"), threshold)
        if all(share >= recall for *_, share in shares):
            break
    else:
        raise RuntimeError(f"recall of {recall} not reached after {max_forests} forests of {trees} trees; (links from, nodes compared, share complete): {shares}")
    placed = nodes.select("node", "label", "vec", "least", "copies").join(parts, "node", "left").join(counted, "node", "left").select(
        "label", "vec", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    per_node = cut(placed.join(named, "component").select("label", "vec", "component_id", "n_links"), "classes")
    by_row = clean.join(per_node, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    apart = src.filter(~F.coalesce(ok, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return by_row.union(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
