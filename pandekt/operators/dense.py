"""Exact dense top-k as blocked matrix products.

The pair matrix is never materialised. A task holds one block of questions and
streams chunks past it (or holds the chunks of one cell), keeps at most k rows
per question, and a final ranked cut merges the blocks.

Cells are for many questions. Every chunk belongs to its nearest pivot; a cell
knows its radius. By the triangle inequality no chunk of a cell scores above
question . pivot + |question| * radius. Neighbouring cells form groups as large
as a block. A question first visits the group around its nearest pivots, then
only those with a cell whose bound reaches its k-th best score. Questions with
equal vectors are searched for once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pandekt.operators.ordered import top_k
from pandekt.session import cut_lineage

BLOCK_ROWS = 4096
#: Scores held at once by a task.
SCORES = 1 << 22


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64) if len(col) else np.zeros((0, 0))


def _cut(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """Keep the best k per row: score descending, then id."""
    if not len(rows):
        return rows, scores, ids
    _, id_rank = np.unique(ids, return_inverse=True)
    order = np.lexsort((id_rank, -scores, rows))
    r = rows[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    pos = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
    keep = order[pos < k]
    return rows[keep], scores[keep], ids[keep]


def select_topk(s: np.ndarray, c_ids: np.ndarray, k: int, q_filter=None, c_doc=None):
    """Best k columns per row of a score matrix; -inf entries never count.

    ``q_filter`` restricts a row to the columns of one document (None: all).
    """
    if q_filter is not None:
        # Documents as small numbers, so that the comparison is one of integers.
        number = {d: i for i, d in enumerate(dict.fromkeys(c_doc))}
        wanted = np.array([-1 if w is None else number.get(w, -2) for w in q_filter], dtype=np.int64)
        held = np.array([number[d] for d in c_doc], dtype=np.int64)
        s[(wanted[:, None] != held[None, :]) & (wanted[:, None] != -1)] = -np.inf
    kk = min(k, s.shape[1])
    floor = np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk]
    rows, cols = np.nonzero((s >= floor[:, None]) & np.isfinite(s))
    return _cut(rows, s[rows, cols], np.asarray(c_ids)[cols], k)


def merge_topk(best, part, k: int):
    """Fold the result of one more block into the running top k."""
    return part if best is None else _cut(*(np.concatenate([a, b]) for a, b in zip(best, part)), k)


def _block_topk(q_ids, q_vecs, q_filter, c_ids, c_vecs, c_doc, k, digits, skip_same_id, floors=None):
    """Best k chunks of one chunk block for every question of one block.

    ``floors`` are scores that each question has k chunks for elsewhere: what lies
    below is left out. The score matrix is made for a few questions at a time.
    """
    q_ids, c_ids = np.asarray(q_ids), np.asarray(c_ids)
    if not len(q_ids) or not len(c_ids):
        return np.zeros(0, dtype=np.int64), np.zeros(0), c_ids[:0]
    step, parts = max(1, SCORES // len(c_ids)), []
    for at in range(0, len(q_ids), step):
        rows = slice(at, at + step)
        s = q_vecs[rows] @ c_vecs.T
        found = None
        if floors is not None and np.isfinite(floors[rows]).all():
            # A score is rounded after the cut: it may rise by half a digit.
            r, c = np.nonzero(s >= floors[rows, None] - 10.0 ** -digits)
            if len(r) <= 16 * k * len(s):
                x = np.round(s[r, c], digits)
                fits = (x >= floors[rows][r]) & np.isfinite(x)
                if skip_same_id:
                    fits &= q_ids[rows][r] != c_ids[c]
                found = _cut(r[fits], x[fits], c_ids[c[fits]], k)
        if found is None:
            s = np.round(s, digits, out=s)
            if skip_same_id:
                s[q_ids[rows, None] == c_ids[None, :]] = -np.inf
            found = select_topk(s, c_ids, k, None if q_filter is None else q_filter[rows], c_doc)
        parts.append((found[0] + at, *found[1:]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, qid: str = "qid", qvec: str = "vec",
               chunk_id: str = "chunk_id", cvec: str = "vec", filter_doc: str | None = None,
               doc_urn: str = "doc_urn", skip_same_id: bool = False, digits: int = 6,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top-k chunks per question by inner product of unit vectors.

    ``filter_doc`` names a question column holding the only document id to
    search (null: all). Scores are rounded to ``digits`` and ties go to the
    smaller chunk id.

    Up to ``block_rows`` questions (checked with a limited count) travel with
    the tasks and chunks are streamed past them without a shuffle. More
    questions visit groups of pivot cells; with ``filter_doc`` they meet the chunks of
    their own document, free ones all cells. All ways compare exactly.
    """
    if k <= 0:
        raise ValueError(f"k must be > 0 (got {k})")
    q_cols = [F.col(qid).alias("qid"), F.col(qvec).alias("qvec")]
    c_cols = [F.col(chunk_id).alias("chunk_id"), F.col(cvec).alias("cvec")]
    if filter_doc:
        q_cols.append(F.col(filter_doc).alias("qdoc"))
        c_cols.append(F.col(doc_urn).alias("cdoc"))
    q, c = queries.select(*q_cols), chunks.select(*c_cols)
    schema = StructType([
        StructField("qid", q.schema["qid"].dataType), StructField("chunk_id", c.schema["chunk_id"].dataType),
        StructField("score", DoubleType()),
    ])
    n_queries = q.select("qid").limit(block_rows + 1).count()
    if n_queries <= block_rows:
        local = _streamed(q, c, schema, k, digits, skip_same_id, bool(filter_doc))
    elif filter_doc:
        free = q.filter(F.col("qdoc").isNull()).drop("qdoc")
        local = _by_document(q.filter(F.col("qdoc").isNotNull()), c, schema, k, digits, skip_same_id, block_rows)
        if free.take(1):
            local = local.unionByName(_visited(free, c.drop("cdoc"), schema, k, digits, skip_same_id, block_rows))
    elif not skip_same_id and _repeats(q):
        return _searched_once(q, c, schema, k, digits, block_rows)
    else:
        local = _visited(q, c, schema, k, digits, skip_same_id, block_rows)
    return top_k(local, ["qid"], [F.desc("score"), F.asc("chunk_id")], k).select("qid", "rank", "chunk_id", "score")


def _repeats(q: DataFrame) -> bool:
    """Whether less than half of the questions have a vector of their own (estimated: it only decides on the way taken)."""
    n, kinds = q.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("qvec"))).first()
    return 2 * kinds < n


def _searched_once(q: DataFrame, c: DataFrame, schema: StructType, k: int, digits: int, block_rows: int) -> DataFrame:
    """One question per distinct vector is searched; the others get its hits."""
    kinds = cut_lineage(q.groupBy("qvec").agg(F.min("qid").alias("qid")))
    if kinds.select("qid").limit(block_rows + 1).count() <= block_rows:
        local = _streamed(kinds, c, schema, k, digits, False, False)
    else:
        local = _visited(kinds, c, schema, k, digits, False, block_rows)
    ranked = top_k(local, ["qid"], [F.desc("score"), F.asc("chunk_id")], k)
    hits = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("_hits"))
    found = kinds.join(hits, "qid").select("qvec", "_hits")
    return q.join(found, "qvec").select("qid", F.inline("_hits")).select("qid", "rank", "chunk_id", "score")


def _streamed(q, c, schema, k, digits, skip, filtered) -> DataFrame:
    block = q.toPandas()  # at most block_rows rows, checked by the caller
    q_ids, q_vecs = block["qid"].to_numpy(), _matrix(block["qvec"])
    q_filter = block["qdoc"].tolist() if filtered else None
    if filtered and len(q_filter) and all(w is not None for w in q_filter):
        # At most one value per question of the block: pushed down to the scan.
        c = c.filter(F.col("cdoc").isin(sorted(set(q_filter))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            if not len(pdf):
                continue
            part = _block_topk(q_ids, q_vecs, q_filter, pdf["chunk_id"].to_numpy(), _matrix(pdf["cvec"]),
                               pdf["cdoc"].tolist() if filtered else None, k, digits, skip)
            best = merge_topk(best, part, k)
        if best is not None and len(best[0]):
            yield pd.DataFrame({"qid": q_ids[best[0]], "chunk_id": best[2], "score": best[1]})
    return c.mapInPandas(run, schema)


def _dealt(left: DataFrame, right: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a cell cut into blocks, each block of one side dealt to every block of the other.

    left(qid, cell, ...), right(chunk_id, cvec, cell), sizes(cell, _qs, _cs): numbers of blocks.
    """
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    qs = left.join(sizes, "cell").withColumn("_q", spread("qid", "_qs")).withColumn("_c", every("_cs")).select(
        F.col("cell").alias("_lk"), F.col("_q").alias("_lq"), F.col("_c").alias("_lc"), *[c for c in left.columns if c != "cell"])
    cs = right.join(sizes, "cell").withColumn("_c", spread("chunk_id", "_cs")).withColumn("_q", every("_qs")).select(
        F.col("cell").alias("_rk"), F.col("_q").alias("_rq"), F.col("_c").alias("_rc"), "chunk_id", "cvec")
    return qs, cs


def _met(left: DataFrame, right: DataFrame, schema: StructType, k: int, digits: int, skip: bool, block_rows: int) -> DataFrame:
    """Best k of the chunks that share ``cell`` with a question, per question and block of about ``block_rows``."""
    def blocks(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(f"_{side}s"))

    return _compared(*_dealt(left, right, blocks(left, "q").join(blocks(right, "c"), "cell")), schema, k, digits, skip)


def _compared(qs: DataFrame, cs: DataFrame, schema: StructType, k: int, digits: int, skip: bool) -> DataFrame:
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        floors = a["floor"].to_numpy() if "floor" in a else None
        r, score, ids = _block_topk(a["qid"].to_numpy(), _matrix(a["qvec"]), None, b["chunk_id"].to_numpy(), _matrix(b["cvec"]), None, k, digits, skip, floors)
        return pd.DataFrame({"qid": a["qid"].to_numpy()[r], "chunk_id": ids, "score": score})

    return qs.groupBy("_lk", "_lq", "_lc").cogroup(cs.groupBy("_rk", "_rq", "_rc")).applyInPandas(run, schema)


def _by_document(q: DataFrame, c: DataFrame, schema: StructType, k: int, digits: int, skip: bool, block_rows: int) -> DataFrame:
    """Questions bound to a document meet its chunks and no others."""
    return _met(q.withColumnRenamed("qdoc", "cell"), c.withColumnRenamed("cdoc", "cell"), schema, k, digits, skip, block_rows)


MAX_PIVOTS = 1024
#: Blocks that meet hold up to so many times ``block_rows`` rows: vectors are sent once per block of the other side.
WIDEST = 8


def _neighbouring(pivots: np.ndarray, held: np.ndarray, most: int) -> np.ndarray:
    """Group of every cell: cells are halved along their widest axis until a group holds at most ``most`` chunks."""
    group, n, todo = np.full(len(pivots), -1), 0, [np.flatnonzero(held > 0)]
    while todo:
        cells = todo.pop()
        if len(cells) > 1 and held[cells].sum() > most:
            axis = np.argmax(np.ptp(pivots[cells], axis=0))
            cells = cells[np.argsort(pivots[cells, axis], kind="stable")]
            half = int(np.clip(np.searchsorted(np.cumsum(held[cells]), held[cells].sum() / 2), 1, len(cells) - 1))
            todo += [cells[:half], cells[half:]]
        elif len(cells):
            group[cells], n = n, n + 1
    return group


def _visited(q: DataFrame, c: DataFrame, schema: StructType, k: int, digits: int, skip: bool, block_rows: int) -> DataFrame:
    """Two visits: the groups of cells around the nearest pivots, then every other group with a cell that may still hold one of the k best.

    A question is sent once to each block of a group it visits, a chunk once to
    each block of its visitors.
    """
    spark = q.sparkSession
    n, n_questions = c.count(), q.count()
    if not n:
        return spark.createDataFrame([], schema)
    wanted = max(1, min(MAX_PIVOTS, int(n ** 0.5)))
    # At most MAX_PIVOTS vectors: they and the radii travel with the tasks.
    pivots = _matrix(c.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).select("cvec").toPandas()["cvec"])
    norms = (pivots * pivots).sum(axis=1)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = _matrix(pdf["cvec"])
            if len(v):
                cell = np.argmin(norms[None, :] - 2 * (v @ pivots.T), axis=1)
                yield pdf.assign(cell=cell, dist=np.sqrt(((v - pivots[cell]) ** 2).sum(axis=1)))

    placed = cut_lineage(c.mapInPandas(nearest, StructType([*c.schema, StructField("cell", LongType()), StructField("dist", DoubleType())])))
    meta = placed.groupBy("cell").agg(F.max("dist").alias("r"), F.count(F.lit(1)).alias("n")).toPandas()
    radius, held = np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=np.int64)
    radius[meta["cell"]], held[meta["cell"]] = meta["r"], meta["n"]
    # Large enough to move little, small enough to give every core several pairs of blocks.
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = int(np.clip((n / tasks * n_questions) ** 0.5, block_rows, WIDEST * block_rows))
    group = _neighbouring(pivots, held, rows)
    live = np.flatnonzero(group >= 0)
    live = live[np.argsort(group[live], kind="stable")]
    start = np.flatnonzero(np.r_[True, np.diff(group[live]) > 0])
    size = np.add.reduceat(held[live], start)
    # A score is rounded and a distance computed: neither may hide a tie.
    margin = 2 * 10.0 ** -digits

    def chosen(dots: np.ndarray) -> np.ndarray:
        """First groups of every question: those of the nearest pivots until they hold k chunks (and the question's own)."""
        order = np.argsort(-np.maximum.reduceat(dots, start, axis=1), axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        first = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(first, order, before < k + 1, axis=1)
        return first

    def visits(second: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), 512):
                    pdf = whole.iloc[at:at + 512]
                    v = _matrix(pdf["qvec"])
                    dots = v @ pivots[live].T
                    go = chosen(dots)
                    if second:
                        bound = dots + np.sqrt((v * v).sum(axis=1))[:, None] * radius[live][None, :] * (1 + 1e-9)
                        go = ~go & (np.maximum.reduceat(bound, start, axis=1) + margin >= pdf["floor"].to_numpy()[:, None])
                    yield pdf.assign(cells=[np.flatnonzero(x) for x in go])
        return run

    cells = spark.createDataFrame(pd.DataFrame({"_cell": live, "cell": group[live]}), "_cell long, cell long")
    right = placed.withColumnRenamed("cell", "_cell").join(F.broadcast(cells), "_cell").select("chunk_id", "cvec", "cell")

    def met(going: DataFrame, second: bool) -> DataFrame:
        sent = cut_lineage(going.mapInPandas(visits(second), StructType([*going.schema, StructField("cells", ArrayType(LongType()))])))
        # One row per group, MAX_PIVOTS at most.
        count = sent.select(F.explode("cells").alias("cell")).groupBy("cell").count().toPandas()
        if not len(count):
            return spark.createDataFrame([], schema)
        blocks = lambda x: -(-x // rows)
        sizes = pd.DataFrame({"cell": count["cell"], "_qs": blocks(count["count"]), "_cs": blocks(size[count["cell"]])})
        qs, cs = _dealt(sent.select(*[x for x in sent.columns if x != "cells"], F.explode("cells").alias("cell")), right,
                        F.broadcast(spark.createDataFrame(sizes, "cell long, _qs int, _cs int")))
        # A pair of blocks takes far longer than its few MB suggest: without a number adaptive execution would put many into one task.
        pairs = int((sizes["_qs"] * sizes["_cs"]).sum())
        parts = max(1, min(2 * pairs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)))
        return _compared(qs.repartition(parts, "_lk", "_lq", "_lc"), cs.repartition(parts, "_rk", "_rq", "_rc"), schema, k, digits, skip)

    near = cut_lineage(met(q, False))
    floors = top_k(near, ["qid"], [F.desc("score"), F.asc("chunk_id")], k).filter(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    return near.unionByName(met(q.join(floors, "qid", "left").fillna({"floor": float("-inf")}), True))
