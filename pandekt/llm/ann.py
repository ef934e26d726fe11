"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard.

Distinct vectors are dealt to shards by hash. A shard is built by one task:
points are inserted in growing batches; a greedy search from the medoid
proposes neighbours; relaxed pruning keeps the nearest candidate and drops those
that it is clearly closer to than the point is, which leaves diverse edges;
reverse edges are added and pruned alike. Graphs are files in the shared
folder. Every query walks every shard with a beam, the found vectors are scored
again in double precision, and the best over all shards are kept.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pandekt.llm.common import AtomicFile, cut, new_folder, open_shared, written
from pandekt.llm.vectors import clean_zero, exact_cosine, matrix, require_one_length, unit_rows, usable

DEGREE = 32
SLACK_DEGREE = 48
BUILD_BEAM = 48
SEARCH_BEAM = 128
RELAX = 1.2
SHARD_ROWS = 200_000
MIN_SHARDS = 12
QUERY_CHUNK = 4096
SEEN_CELLS = 1 << 25


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors: ids is (queries, m)."""
    return 2.0 - 2.0 * np.matmul(x[ids], q[:, :, None])[:, :, 0]


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray, list]:
    """Greedy search of many queries at once.

    Returns the beam (ids and squared distances, nearest first, -1 where the
    graph has no more) and the expanded points of every step. ``width`` points per
    query are expanded in a step; a point enters a query's beam once.
    """
    n_q, rows = len(queries), np.arange(len(queries))
    seen = np.zeros((n_q, len(x)), dtype=bool)
    ids = np.full((n_q, beam), -1, dtype=np.int32)
    dist = np.full((n_q, beam), np.inf, dtype=np.float32)
    open_ = np.zeros((n_q, beam), dtype=bool)
    ids[:, 0], dist[:, 0], open_[:, 0] = entry, _distances(x, np.full((n_q, 1), entry), queries)[:, 0], True
    seen[:, entry] = True
    visited = []
    active = rows
    while len(active):
        rank = np.where(open_[active], dist[active], np.inf)
        pick = np.argpartition(rank, width - 1, axis=1)[:, :width] if beam > width else np.tile(np.arange(beam), (len(active), 1))
        use = np.isfinite(np.take_along_axis(rank, pick, axis=1))
        at = active[:, None]
        points = np.where(use, ids[at, pick], -1)
        visited.append((active, points, np.where(use, dist[at, pick], np.inf)))
        open_[at, pick] = False
        near = np.where(points[:, :, None] >= 0, graph[np.maximum(points, 0)], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = (near >= 0) & ~seen[at, np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        d = np.where(fresh, _distances(x, np.maximum(near, 0), queries[active]), np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_dist = np.concatenate([dist[active], d], axis=1)
        all_open = np.concatenate([open_[active], fresh], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[active] = np.where(np.isfinite(np.take_along_axis(all_dist, best, axis=1)), np.take_along_axis(all_ids, best, axis=1), -1)
        dist[active] = np.take_along_axis(all_dist, best, axis=1)
        open_[active] = np.take_along_axis(all_open, best, axis=1) & (ids[active] >= 0)
        active = active[open_[active].any(axis=1)]
    return ids, dist, visited


def robust_prune(x: np.ndarray, candidates: np.ndarray, dist: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Pruned neighbours of many points at once.

    ``candidates`` is (points, m) with -1 for none, ``dist`` their squared
    distances to the point. The nearest candidate left is kept; candidates whose
    distance to it, times ``relax``, is below their distance to the point go.
    """
    order = np.argsort(dist, axis=1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(dist, order, axis=1)
    v = x[np.maximum(candidates, 0)]
    between = np.maximum(2.0 - 2.0 * np.matmul(v, v.transpose(0, 2, 1)), 0)
    left = (candidates >= 0) & np.isfinite(dist)
    out = np.full((len(candidates), degree), -1, dtype=np.int32)
    rows = np.arange(len(candidates))
    for k in range(degree):
        nearest = left.argmax(axis=1)
        any_left = left[rows, nearest]
        if not any_left.any():
            break
        out[:, k] = np.where(any_left, candidates[rows, nearest], -1)
        left &= relax * relax * between[rows, nearest] > dist
        left[rows, nearest] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 5) -> tuple[np.ndarray, int]:
    """(neighbours with -1 for none, entry point) over unit vectors."""
    n = len(x)
    graph = np.full((n, SLACK_DEGREE), -1, dtype=np.int32)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[entry, order[order != entry]]
    done, chunk_cap = 1, max(32, min(256, SEEN_CELLS // max(n, 1)))
    while done < n:
        batch = order[done:done + max(1, min(done, chunk_cap))]
        ids, dist, visited = beam_search(x, graph, entry, x[batch], beam)
        # Candidates: the final beam and all expanded points.
        cand = [ids]
        cdist = [dist]
        for active, points, d in visited:
            full, fd = np.full((len(batch), points.shape[1]), -1, dtype=np.int32), np.full((len(batch), points.shape[1]), np.inf, dtype=np.float32)
            full[active], fd[active] = points, d
            cand.append(full)
            cdist.append(fd)
        cand, cdist = np.concatenate(cand, axis=1), np.concatenate(cdist, axis=1)
        o = np.argsort(cand, axis=1, kind="stable")
        cand, cdist = np.take_along_axis(cand, o, axis=1), np.take_along_axis(cdist, o, axis=1)
        same = np.zeros_like(cand, dtype=bool)
        same[:, 1:] = cand[:, 1:] == cand[:, :-1]
        cand[same], cdist[same] = -1, np.inf
        keep = np.argsort(np.where(cand >= 0, cdist, np.inf), axis=1, kind="stable")[:, :96]
        cand, cdist = np.take_along_axis(cand, keep, axis=1), np.take_along_axis(np.where(cand >= 0, cdist, np.inf), keep, axis=1)
        for a in range(0, len(batch), 64):
            part = slice(a, a + 64)
            graph[batch[part], :degree] = robust_prune(x, cand[part], cdist[part], degree, relax)
        _add_reverse(x, graph, batch, degree, relax)
        done += len(batch)
    return graph, entry


def _add_reverse(x: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int, relax: float) -> None:
    """Add edges back to the batch; a full list is pruned together with what came new."""
    targets = graph[batch, :degree]
    source = np.repeat(batch, degree)[targets.ravel() >= 0]
    target = targets.ravel()[targets.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
    counts = np.diff(np.r_[first, len(target)])
    have = (graph[target[first]] >= 0).sum(axis=1)
    room = have + counts <= SLACK_DEGREE
    # Lists with room: append.
    nth = np.arange(len(target)) - np.repeat(first, counts)
    fits = np.repeat(room, counts)
    graph[target[fits], np.repeat(have, counts)[fits] + nth[fits]] = source[fits]
    for k in np.flatnonzero(~room):
        t = target[first[k]]
        cand = np.unique(np.r_[graph[t][graph[t] >= 0], source[first[k]:first[k] + counts[k]]])
        cand = cand[cand != t][None, :]
        graph[t] = -1
        graph[t, :degree] = robust_prune(x, cand, _distances(x, cand, x[t][None, :]).astype(np.float32), degree, relax)[0]


# Shards as files.

def shard_uri(folder: str, shard: int) -> str:
    return f"{folder}/graphs/shard-{shard:05d}.npz"


def write_index(nodes: DataFrame, folder: str, shards: int, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> DataFrame:
    """Build and store the graph of every shard; ``nodes`` has node, least and vec. Returns (shard, n) rows."""
    # By range: one shard to a task, where hashes of a few numbers would collide.
    dealt = nodes.select(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(shards)).alias("shard"), "node", "least", "vec").repartitionByRange(shards, "shard").sortWithinPartitions("shard", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def close():
            node, least = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            vec = np.concatenate([h[2] for h in held])
            graph, entry = build_graph(unit_rows(vec).astype(np.float32), degree, beam, relax)
            buffer = io.BytesIO()
            np.savez(buffer, node=node, least=least, vec=vec, graph=graph, entry=np.array([entry]))
            out = AtomicFile(shard_uri(folder, current))
            out.write(buffer.getvalue())
            out.publish()
            return pa.RecordBatch.from_pydict({"shard": pa.array([current], pa.int64()), "n": pa.array([len(node)], pa.int64())})

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for s in np.unique(shard).tolist():
                part = batch.filter(pa.array(shard == s))
                if s != current and held:
                    yield close()
                    held = []
                current = s
                held.append((part.column("node").to_numpy(), part.column("least").to_numpy(), matrix(part.column("vec"))))
        if held:
            yield close()

    return written(dealt.mapInArrow(run, "shard long, n long"), f"{folder}/index")


def search_index(queries: DataFrame, index: DataFrame, folder: str, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, node, least, score): for every query the k best nodes of every shard.

    Queries meet each shard in chunks, so one task holds one graph and one
    chunk of queries at a time.
    """
    n_queries = queries.count()
    chunks = max(1, -(-n_queries // QUERY_CHUNK))
    numbers = [r["shard"] for r in index.select("shard").collect()]
    if not numbers:
        return queries.select("query_id", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("least"), F.lit(0.0).alias("score")).limit(0)
    each = queries.select("query_id", "vec", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk"), F.explode(F.array(*[F.lit(s).cast("long") for s in numbers])).alias("shard"))
    dealt = each.repartitionByRange(len(numbers) * chunks, "shard", "chunk").sortWithinPartitions("shard", "chunk", "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, shard = None, [], None

        def load(s):
            with open_shared(shard_uri(folder, s)) as f:
                data = np.load(io.BytesIO(f.read()))
                return {name: data[name] for name in data.files}

        def close():
            ids, q = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            x = unit_rows(shard["vec"]).astype(np.float32)
            width = min(beam, max(4, len(x)))
            step = max(8, min(256, SEEN_CELLS // len(x)))
            for a in range(0, len(ids), step):
                part, own = ids[a:a + step], q[a:a + step]
                found, _, _ = beam_search(x, shard["graph"], int(shard["entry"][0]), unit_rows(own).astype(np.float32), width)
                found = found[:, :max(3 * k, 16)]
                r, c = np.nonzero(found >= 0)
                at = found[r, c]
                score = exact_cosine(own[r], shard["vec"][at])
                order = np.lexsort((shard["least"][at], -score, r))
                r, at, score = r[order], at[order], score[order]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                best = nth < k
                yield pa.RecordBatch.from_arrays([pa.array(part[r[best]]), pa.array(shard["node"][at[best]]), pa.array(shard["least"][at[best]]), pa.array(score[best])], names=["query_id", "node", "least", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            s, c = batch.column("shard").to_numpy(), batch.column("chunk").to_numpy()
            edges = np.r_[0, np.flatnonzero((s[1:] != s[:-1]) | (c[1:] != c[:-1])) + 1, len(s)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (int(s[a]), int(c[a])) != current:
                    if held:
                        yield from close()
                    if current is None or current[0] != int(s[a]):
                        shard = load(int(s[a]))
                    current, held = (int(s[a]), int(c[a])), []
                held.append((batch.column("query_id").to_numpy()[a:b], matrix(batch.column("vec").slice(a, b - a))))
        if held:
            yield from close()

    return dealt.mapInArrow(run, "query_id long, node long, least long, score double")


def nearest(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, query_step: int = 50, shards: int | None = None,
            beam: int = SEARCH_BEAM, folder: str | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest other rows of every row whose id is divisible by ``query_step``.

    Nearness is the cosine, ties go to the smaller id; with fewer than k
    candidates all are returned. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id, take no part. Equal vectors
    are one point of a graph and all their rows are candidates (the k + 1
    smallest ids suffice for any query). Vectors of different length raise.
    Rows that repeat an id and a vector are one row. Rows that share an id with
    different vectors are all candidates of other queries, one by one; the query
    of that id is the smallest of its vectors, and no row of its own id is its
    candidate.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = rows.sparkSession
    src = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"))
    clean = cut(src.filter(usable(F.col("vec")) & F.col("vec_id").isNotNull()).select("vec_id", clean_zero(F.col("vec")).alias("vec")), "vectors")
    w = Window.partitionBy("node").orderBy("vec_id")
    # Ranked limits apply before the shuffle: a vector with very many copies sends k + 1 rows per task.
    require_one_length(clean)
    first = clean.select("vec_id", F.xxhash64("vec").alias("node")).distinct().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1)
    members = cut(first.groupBy("node").agg(F.min("vec_id").alias("least"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "members")
    nodes = cut(members.select("node", F.col("least").alias("vec_id")).join(clean, "vec_id").filter(F.xxhash64("vec") == F.col("node")).select("node", F.col("vec_id").alias("least"), "vec").dropDuplicates(["node"]), "nodes")
    shards = shards or max(MIN_SHARDS, -(-nodes.count() // SHARD_ROWS))
    folder = folder or new_folder(spark, "ann")
    index = write_index(nodes, folder, shards)
    asked = clean.filter(F.col("vec_id") % query_step == 0).select(F.col("vec_id").alias("query_id"), "vec").groupBy("query_id").agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("own"))
    # So many of the nearest may be rows of the query's own id.
    own = asked.agg(F.max("own")).first()[0] or 1
    queries = asked.select("query_id", "vec")
    found = search_index(queries, index, folder, k + own, beam)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "least")
    top = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + own)
    each = top.join(members.select("node", "ids"), "node").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
