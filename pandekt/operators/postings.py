"""BM25 over blocked postings, searched with upper bounds (MaxScore).

Chunks are numbered inside shards of bounded size. A row of the block table is
up to BLOCK postings of one word in one shard: positions, counts, and what
bounds their weight, the largest count and the shortest chunk. A row with the
empty word describes the shard itself: ids, documents and lengths of its chunks.
Rows are kept in ranges of (word, shard), so a filter on words leaves most row
groups unread.

A search brings the blocks of the asked words of a shard together with a block
of questions. Per question, words are taken in by falling bound; once the words
left cannot lift a new chunk over the k-th best, only the chunks seen so far are
looked up in the rest. Survivors are scored word by word in byte order, the
order in which chunks are scored when no index is stored: both give equal sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from pandekt.functions.text import words
from pandekt.operators.embedding import word_runs

K1, B = 1.2, 0.75
BLOCK = 128
SHARD_ROWS = 8192
#: What bounds the memory in which the words of a shard are sorted.
SHARD_WORDS = 1 << 21
QUESTION_ROWS = 4096
#: Up to so many words are asked for by a literal filter that row groups are checked against.
LITERAL_WORDS = 256
#: Up to so many words (times blocks of questions) travel with the tasks that read postings; beyond that postings are shuffled to meet them.
SENT_WORDS = 1 << 17
SHARD_ROW = ""


def idf(n_docs: float, df: np.ndarray | float):
    """Non-negative inverse document frequency."""
    return np.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def saturation(tf, dl, avgdl: float, k1: float = K1, b: float = B):
    """Grows with the count and falls with the length, so (largest count, shortest chunk) bounds a block."""
    return (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl))


def block_schema(id_type: DataType) -> str:
    kind = id_type.simpleString()
    return f"term string, shard string, n long, max_tf long, min_dl long, pos array<int>, tf array<int>, ids array<{kind}>, urns array<string>, dls array<int>"


def posting_blocks(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", doc_urn: str | None = "doc_urn", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Block table of ``chunks``. Shard names are drawn anew at every evaluation: write it before it is used twice."""
    urn = F.col(doc_urn).cast("string") if doc_urn else F.lit(None).cast("string")
    return blocks_of_words(chunks.select(F.col(chunk_id).alias("id"), urn.alias("urn"), words(F.col(text)).alias("w")), shard_rows)


def placed(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, urn, dl, w, shard, pos): ``rows`` (id, urn, w) with the length and place of each; rows without a list get none.

    Shard names are drawn anew at every evaluation: write it before it is used.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            there = whole.column("w").is_valid()
            for part, living in ((whole.filter(there), True), (whole.filter(pc.invert(there)), False)):
                n, shard, pos = part.num_rows, [], []
                for at, end in word_runs(part.column("w"), SHARD_WORDS, shard_rows) if living else ():
                    shard += [uuid.uuid4().hex] * (end - at)
                    pos += range(end - at)
                dl = pc.list_value_length(part.column("w")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("urn"), dl, part.column("w"), pa.array(shard if living else [None] * n, pa.string()), pa.array(pos if living else [None] * n, pa.int32())],
                    names=["id", "urn", "dl", "w", "shard", "pos"])

    return rows.select("id", "urn", "w").mapInArrow(run, f"id {kind}, urn string, dl long, w array<string>, shard string, pos int")


def blocks_of_words(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Block table of (id, urn, w), where w lists the words of a chunk, repeats included."""
    names = ["term", "shard", "n", "max_tf", "min_dl", "pos", "tf", "ids", "urns", "dls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, end in word_runs(whole.column("w"), SHARD_WORDS, shard_rows):
                yield _one_shard(whole.slice(at, end - at), names)

    return rows.select("id", "urn", "w").mapInArrow(run, block_schema(rows.schema["id"].dataType))


def blocks_of_places(rows: DataFrame) -> DataFrame:
    """Block table of (id, urn, dl, w, shard, pos), whose places were given before; every row of a shard must be there.

    Rows may come in any order. A word of a shard gets blocks of its own from every
    run of places that follow one another, so the places of its blocks never mix.
    """
    names, cells = ["term", "shard", "n", "max_tf", "min_dl", "pos", "tf"], "term string, shard string, n long, max_tf long, min_dl long, pos array<int>, tf array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            shard, pos = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "pos"))
            edges = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (pos[1:] != pos[:-1] + 1), True])
            for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for at, end in word_runs(whole.column("w").slice(first, last - first), SHARD_WORDS):
                    own = slice(first + at, first + end)
                    term, *rest = _sorted_blocks(whole.column("w").slice(first + at, end - at), pos[own])
                    yield pa.RecordBatch.from_arrays([term, pa.array([shard[first]] * len(term), pa.string()), *rest], names=names)

    own = rows.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "urn", "dl"))).alias("_r")).select(
        F.lit(SHARD_ROW).alias("term"), "shard", F.size("_r").cast("long").alias("n"), F.lit(0).cast("long").alias("max_tf"), F.lit(0).cast("long").alias("min_dl"),
        F.col("_r.id").alias("ids"), F.col("_r.urn").alias("urns"), F.col("_r.dl").cast("array<int>").alias("dls"))
    return rows.select("shard", "pos", "w").mapInArrow(run, cells).unionByName(own, allowMissingColumns=True)


def _sorted_blocks(lists: pa.Array, places: np.ndarray) -> tuple[pa.Array, ...]:
    """term, n, max_tf, min_dl, pos and tf of the blocks of word lists at rising ``places``."""
    dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    n_rows = len(lists)
    key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_rows + np.repeat(np.arange(n_rows), dl), return_counts=True)
    word, pos = key // n_rows, key % n_rows
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, dtype=np.int64)
    start = (np.arange(len(word)) - np.repeat(first, np.diff(np.r_[first, len(word)]))) % BLOCK == 0
    start = np.flatnonzero(start)
    size = np.diff(np.r_[start, len(word)])
    top = np.maximum.reduceat(tf, start) if len(start) else tf
    short = np.minimum.reduceat(dl[pos], start) if len(start) else tf
    offsets = pa.array(np.r_[start, len(word)].astype(np.int32))
    cells = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
    return coded.dictionary.take(pa.array(word[start])).cast(pa.string()), *(pa.array(x.astype(np.int64)) for x in (size, top, short)), cells(places[pos]), cells(tf)


def _one_shard(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    lists, n_rows = batch.column("w"), batch.num_rows
    dl = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())
    term, size, top, short, pos, tf = _sorted_blocks(lists, np.arange(n_rows))
    n = len(term)
    shard = pa.array([uuid.uuid4().hex] * (n + 1))
    ids, urns, none = pa.array([batch.column("id").to_pylist()], pa.list_(batch.column("id").type)), pa.array([batch.column("urn").to_pylist()], pa.list_(pa.string())), pa.int32()
    whole = lambda x, own: pa.concat_arrays([x, pa.array([own], x.type)])
    return pa.RecordBatch.from_arrays([
        whole(term, SHARD_ROW), shard, whole(size, n_rows), whole(top, 0), whole(short, 0), whole(pos, None), whole(tf, None),
        pa.concat_arrays([pa.nulls(n, ids.type), ids]), pa.concat_arrays([pa.nulls(n, urns.type), urns]), pa.concat_arrays([pa.nulls(n, pa.list_(none)), pa.array([dl.to_pylist()], pa.list_(none))]),
    ], names=names)


def block_stats(blocks: DataFrame) -> DataFrame:
    """One row (n_docs, total): chunks and words of the corpus. Only the shards' own rows are read."""
    own = blocks.filter(F.col("term") == SHARD_ROW)
    return own.select("n", F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def block_frequencies(blocks: DataFrame) -> DataFrame:
    """(term, df) of all words; no list is read."""
    return blocks.filter(F.col("term") != SHARD_ROW).groupBy("term").agg(F.sum("n").alias("df"))


def only_words(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """``blocks`` under a literal filter when few words are asked: the scan skips row groups without any of them."""
    few = [r.term for r in asked.select("term").distinct().limit(LITERAL_WORDS + 1).collect()]
    if len(few) > LITERAL_WORDS:
        return blocks.filter(F.col("term") != SHARD_ROW)
    if not few:
        return blocks.limit(0)
    # One comparison each: long IN lists reach the scan as a range only.
    return blocks.filter(reduce(lambda a, b: a | b, [F.col("term") == w for w in few]))


def search_blocks(questions: DataFrame, blocks: DataFrame, k: int, frequencies: DataFrame | None = None, stats: DataFrame | None = None,
                  filtered: bool = False, digits: int = 6, question_rows: int = QUESTION_ROWS, dead: DataFrame | None = None) -> DataFrame:
    """Best k chunks of every shard per question: (qid, chunk_id, score).

    ``questions`` has qid, want and terms. With ``filtered`` a question sees the
    chunks of the document ``want`` only (null: all), and shards without that
    document are not visited for it. ``dead`` (shard, dead: positions) hides chunks.
    """
    frequencies = block_frequencies(blocks) if frequencies is None else frequencies
    n_docs, total = (block_stats(blocks) if stats is None else stats).select("n_docs", "total").first()
    kind = blocks.schema["ids"].dataType.elementType
    schema = StructType([StructField("qid", questions.schema["qid"].dataType), StructField("chunk_id", kind), StructField("score", DoubleType())])
    if not n_docs or not total:
        return questions.sparkSession.createDataFrame([], schema)
    parts = max(1, -(-questions.count() // question_rows))
    q = questions.withColumn("qblock", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
    own = blocks.filter(F.col("term") == SHARD_ROW).select("shard", "ids", "urns", "dls")
    asked = q.select("qblock", "want", F.explode("terms").alias("term"))
    df = frequencies.join(asked.select("term").distinct(), "term", "left_semi")
    lists = only_words(blocks, asked).select("term", "shard", "max_tf", "min_dl", "pos", "tf")
    sent = F.broadcast if asked.select("qblock", "term").distinct().limit(SENT_WORDS + 1).count() <= SENT_WORDS else lambda x: x
    if filtered:
        # Bound questions meet the shards of their document, free ones all.
        places = own.select("shard", F.explode(F.array_distinct("urns")).alias("want"))
        bound = asked.filter(F.col("want").isNotNull()).join(places, "want").select("qblock", "term", "shard").distinct().join(df, "term")
        free = asked.filter(F.col("want").isNull()).select("qblock", "term").distinct().join(df, "term")
        left = lists.join(bound, ["term", "shard"]).unionByName(lists.join(sent(free), "term").select(*lists.columns, "qblock", "df"), allowMissingColumns=True)
    else:
        left = lists.join(sent(asked.select("qblock", "term").distinct().join(df, "term")), "term")
    block = q.groupBy(F.col("qblock").alias("_q")).agg(F.collect_list(F.struct("qid", "want", "terms")).alias("qs"))
    right = own.withColumnRenamed("shard", "_s").withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(block, "_q")
    # New names on this side: both come from the same tables.
    hidden = F.lit(None).cast("array<int>").alias("dead")
    if dead is not None:
        right, hidden = right.join(dead.withColumnRenamed("shard", "_s"), "_s", "left"), F.col("dead")
    right = right.select(F.col("_s").alias("own_shard"), F.col("_q").alias("own_block"), "ids", "urns", "dls", hidden, "qs")
    avgdl = total / n_docs

    def run(lists: pa.Table, shard: pa.Table) -> pa.Table:
        found = [_search_shard(lists, shard, i, k, n_docs, avgdl, filtered, digits) for i in range(shard.num_rows)] if lists.num_rows else []
        qids, ids, scores = (sum((f[j] for f in found), []) for j in range(3)) if found else ([], [], [])
        return pa.table({"qid": pa.array(qids, shard.schema.field("qs").type.value_type.field("qid").type), "chunk_id": pa.array(ids, shard.schema.field("ids").type.value_type), "score": pa.array(scores, pa.float64())})

    # Searching a shard takes far longer than its few MB suggest: without a number adaptive execution would put many into one task.
    spark = questions.sparkSession
    groups = parts * own.count()
    n = max(1, min(2 * groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))
    left, right = left.repartition(n, "shard", "qblock"), right.repartition(n, "own_shard", "own_block")
    return left.groupBy("shard", "qblock").cogroup(right.groupBy("own_shard", "own_block")).applyInArrow(run, schema)


class _Word:
    """Postings of one word in one shard; a block is weighed when it is first needed."""

    def __init__(self, pos: list, tf: list, bounds: np.ndarray, factor: float, dls: np.ndarray, avgdl: float) -> None:
        order = np.argsort([p[0] for p in pos], kind="stable")
        self.pos, self.tf = [pos[i] for i in order], [tf[i] for i in order]
        self.bound = factor * bounds.max()
        self.first = np.array([p[0] for p in self.pos])
        self.factor, self.dls, self.avgdl = factor, dls, avgdl
        self._weights: list = [None] * len(self.pos)

    def _weigh(self, i: int) -> np.ndarray:
        if self._weights[i] is None:
            self._weights[i] = self.factor * saturation(self.tf[i], self.dls[self.pos[i]], self.avgdl)
        return self._weights[i]

    def add_all(self, scores: np.ndarray) -> None:
        for i, pos in enumerate(self.pos):
            scores[pos] += self._weigh(i)

    def at(self, chunks: np.ndarray) -> np.ndarray:
        """Weights of rising chunk numbers; only blocks that may hold one are looked into."""
        out = np.zeros(len(chunks))
        if not len(chunks):
            return out
        cell = np.searchsorted(self.first, chunks, side="right") - 1
        edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for a, b in zip(edge, [*edge[1:], len(cell)], strict=True):
            i = cell[a]
            if i >= 0:
                pos = self.pos[i]
                j = np.minimum(np.searchsorted(pos, chunks[a:b]), len(pos) - 1)
                out[a:b] = np.where(pos[j] == chunks[a:b], self._weigh(i)[j], 0.0)
        return out


def _search_shard(lists: pa.Table, shard: pa.Table, row: int, k: int, n_docs: int, avgdl: float, filtered: bool, digits: int) -> tuple[list, list, list]:
    ids, dls = shard.column("ids")[row].as_py(), np.array(shard.column("dls")[row].as_py(), dtype=np.int64)
    urns = np.array(shard.column("urns")[row].as_py(), dtype=object) if filtered else None
    gone = shard.column("dead")[row].as_py()
    living = None
    if gone:
        living = np.ones(len(ids), dtype=bool)
        living[gone] = False
    grouped: dict[str, dict] = {}
    pos_lists, tf_lists = lists.column("pos").combine_chunks(), lists.column("tf").combine_chunks()
    top, df = saturation(lists.column("max_tf").to_numpy(), lists.column("min_dl").to_numpy(), avgdl), lists.column("df").to_numpy()
    for i, term in enumerate(lists.column("term").to_pylist()):
        pos = pos_lists[i].values.to_numpy()
        # A block asked for by bound and free questions comes twice.
        grouped.setdefault(term, {})[int(pos[0])] = (pos, tf_lists[i].values.to_numpy().astype(np.int64), top[i], df[i])
    known = {t: _Word([x[0] for x in b.values()], [x[1] for x in b.values()], np.array([x[2] for x in b.values()]), idf(n_docs, next(iter(b.values()))[3]), dls, avgdl) for t, b in grouped.items()}
    margin = 2 * 10.0 ** -digits
    out_q, out_c, out_s = [], [], []
    for q in shard.column("qs")[row].as_py():
        mine = sorted({t for t in q["terms"] if t in known})
        if not mine:
            continue
        allowed = living
        if filtered and q["want"] is not None:
            allowed = (urns == q["want"]) if living is None else (urns == q["want"]) & living
        if allowed is not None and not allowed.any():
            continue
        by_bound = sorted(mine, key=lambda t: -known[t].bound)
        rest = np.r_[np.cumsum([known[t].bound for t in by_bound][::-1])[::-1], 0.0]
        scores, seen = np.zeros(len(ids)), None
        for i, t in enumerate(by_bound):
            known[t].add_all(scores)
            if allowed is not None:
                scores[~allowed] = 0.0
            if scores.max(initial=0.0) <= rest[i + 1] and i + 1 < len(by_bound):
                continue
            floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else 0.0
            if rest[i + 1] + margin < floor or i + 1 == len(by_bound):
                # No chunk without a word so far can get over the floor.
                seen = np.flatnonzero((scores > 0) & (scores + rest[i + 1] + margin >= floor))
                for j in range(i + 1, len(by_bound)):
                    scores[seen] += known[by_bound[j]].at(seen)
                    if len(seen) > k:
                        floor = np.partition(scores[seen], len(seen) - k)[len(seen) - k]
                        seen = seen[scores[seen] + rest[j + 1] + margin >= floor]
                break
        exact = np.zeros(len(seen))
        for t in mine:
            exact += known[t].at(seen)
        exact = np.round(exact, digits)
        seen, exact = seen[exact > 0], exact[exact > 0]
        best = sorted(zip((-exact).tolist(), [ids[c] for c in seen.tolist()], strict=True), key=lambda x: (x[0], x[1]))[:k]
        out_q.extend([q["qid"]] * len(best))
        out_c.extend(c for _, c in best)
        out_s.extend(-s for s, _ in best)
    return out_q, out_c, out_s
