"""Ranked lexical search over K2-treaps, one per shard of documents.

A shard is the term-document grid of a bounded number of words: rows are terms,
most frequent first, columns are documents. The grid is cut into quarters again
and again. A cell that holds something is a node: four bits tell which of its
quarters do, and its impact maximum is stored as the difference from that of the
cell around it. Nodes of a level follow each other in the order of their
parents, so a child is found by counting bits and no pointers are stored.

A search walks ranges of documents, best bound first. A range carries, for
every term of the item, the cell that holds that term's row and the range; its
bound is the sum of the cells' maxima times the terms' weights. Halving a range
moves every row path one level down. At single documents the bound is the
score; the walk ends when no bound left can beat the k-th best.
"""

from __future__ import annotations

import io
import json
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pandekt.llm.common import AtomicFile, bytes_of, cut, new_folder, open_shared, released, row_slices, small_batches
from pandekt.llm.terms import LETTERS_AND_DIGITS, term_lists

K = 10
#: Words of a shard; one more document may go over it.
SHARD_WORDS = 3_000_000
#: Ranges opened at a time, and items held at a time by a task.
BEAM = 64
ITEM_ROWS = 512
#: Cells that the open ranges of one walk may hold.
OPEN_CELLS = 1 << 21
_BITS = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], dtype=np.int64)
_COUNT = np.array([bin(m).count("1") for m in range(16)], dtype=np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_norm(n: int, n_docs: int, n_terms: int) -> int:
    """Of a document of ``n`` terms, among ``n_docs`` documents of ``n_terms`` terms altogether."""
    return 100 - 90 + 90 * n * n_docs // n_terms


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Treap:
    """K2-treap over (row, column, value) points of a square grid."""

    def __init__(self, height: int, masks: list[np.ndarray], drops: list[np.ndarray], root: int) -> None:
        self.height, self.masks, self.drops, self.root = height, masks, drops, root
        self._first: list[np.ndarray] = []
        self._top: list[np.ndarray] = [np.array([root], dtype=np.int64)]
        for mask, drop in zip(masks, drops, strict=True):
            n = _COUNT[mask]
            self._first.append(np.cumsum(n) - n)
            self._top.append(np.repeat(self._top[-1], n) - drop)

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, size: int) -> Treap:
        """``size``: rows and columns are below it. Points are distinct and there is at least one."""
        height = max(1, int(size - 1).bit_length())
        code = _interleave(rows) << np.uint64(1) | _interleave(columns)
        order = np.argsort(code)
        code, top = code[order], values[order].astype(np.int64)
        masks, drops = [], []
        for _ in range(height):
            quarter = (code & np.uint64(3)).astype(np.int64)
            parent = code >> np.uint64(2)
            first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            n = np.diff(np.r_[first, len(parent)])
            best = np.maximum.reduceat(top, first)
            masks.append(np.add.reduceat(1 << quarter, first).astype(np.uint8))
            drops.append((np.repeat(best, n) - top).astype(np.int32))
            code, top = parent[first], best
        return cls(height, masks[::-1], drops[::-1], int(top[0]))

    def step(self, level: int, node: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """Names on level ``level + 1`` of the quarters of nodes on ``level``; -1 for nothing."""
        mask = self.masks[level][node]
        child = self._first[level][node] + _BITS[mask, quarter]
        return np.where((node >= 0) & (mask >> quarter & 1 == 1), child, -1)

    def top(self, level: int, node: np.ndarray) -> np.ndarray:
        return np.where(node >= 0, self._top[level][node], 0)

    def search(self, rows: np.ndarray, weights: np.ndarray, n_columns: int, k: int, beam: int = BEAM) -> list[tuple[int, int]]:
        """The k best (score, column) with a score above 0, larger first, then smaller columns."""
        best: list[tuple[int, int]] = []
        if not len(rows) or not n_columns:
            return best
        # Items of very many terms walk stripes of columns one after the other: open ranges hold a cell a term.
        level = 0
        while level < self.height and len(rows) << self.height - level > OPEN_CELLS:
            level += 1
        for stripe in range((n_columns - 1 >> self.height - level) + 1):
            cells = np.zeros((1, len(rows)), dtype=np.int64)
            for depth in range(level):
                shift = self.height - 1 - depth
                half = stripe >> level - 1 - depth & 1
                cells = self.step(depth, cells, ((rows >> shift & 1) << 1 | half)[None, :])
            best = self._walk(rows, weights, k, beam, best, level, stripe, cells)
        return best

    def _walk(self, rows: np.ndarray, weights: np.ndarray, k: int, beam: int, best: list, level: int, span: int, cells: np.ndarray) -> list[tuple[int, int]]:
        """Best-first below one range; ``best`` holds what other ranges gave."""
        # Open ranges by level; the bounds of all levels are compared.
        bounds, levels, spans = self.top(level, cells) @ weights, np.array([level]), np.array([span])
        if level == self.height:
            found = [(int(bounds[0]), span)] if bounds[0] > 0 else []
            return sorted(best + found, key=lambda x: (-x[0], x[1]))[:k]
        floor = best[-1][0] if len(best) == k else 1
        open_ = bounds >= floor
        bounds, levels, spans, cells = bounds[open_], levels[open_], spans[open_], cells[open_]
        while len(bounds):
            pick = np.argsort(-bounds, kind="stable")[:beam]
            rest = np.ones(len(bounds), dtype=bool)
            rest[pick] = False
            grown: list[tuple] = [(bounds[rest], levels[rest], spans[rest], cells[rest])]
            for level in np.unique(levels[pick]):
                at = pick[levels[pick] == level]
                shift = self.height - 1 - level
                down = (rows >> shift & 1) << 1
                child = np.concatenate([self.step(level, cells[at], down[None, :] | half) for half in (0, 1)])
                halves = np.concatenate([spans[at] << 1, spans[at] << 1 | 1])
                bound = self.top(level + 1, child) @ weights
                ok = bound > 0
                if shift == 0:
                    best = best + list(zip(bound[ok].tolist(), halves[ok].tolist(), strict=True))
                else:
                    grown.append((bound[ok], np.full(ok.sum(), level + 1), halves[ok], child[ok]))
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
            floor = best[-1][0] if len(best) == k else 1
            bounds, levels, spans, cells = (np.concatenate([g[j] for g in grown]) for j in range(4))
            # A range whose bound equals the floor may hold an equal score with a smaller column.
            open_ = bounds >= floor
            bounds, levels, spans, cells = bounds[open_], levels[open_], spans[open_], cells[open_]
        return best


def _interleave(x: np.ndarray) -> np.ndarray:
    """Bits of x at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


class Shard:
    """Terms, documents and treap of one shard, and their file."""

    def __init__(self, terms: list[bytes], dfs: np.ndarray, ids: np.ndarray, treap: Treap) -> None:
        self.dfs, self.ids, self.treap = dfs, ids, treap
        self.rows = {t: i for i, t in enumerate(terms)}
        self.terms = terms

    @classmethod
    def build(cls, vocabulary: dict[bytes, int], words: list[np.ndarray], ids: list[int], n_docs: int, n_terms: int) -> Shard:
        """``words``: a document's term numbers of ``vocabulary``, in any order; documents come with their ids."""
        order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
        words, ids = [words[i] for i in order], np.array(ids, dtype=np.int64)[order]
        lengths = np.array([len(w) for w in words])
        key = np.repeat(np.arange(len(words)), lengths) << 32 | np.concatenate(words).astype(np.int64)
        key, tf = np.unique(key, return_counts=True)
        column, term = key >> 32, key & 0xFFFFFFFF
        df = np.bincount(term, minlength=len(vocabulary))
        by_df = np.argsort(-df, kind="stable")
        row = np.empty(len(by_df), dtype=np.int64)
        row[by_df] = np.arange(len(by_df))
        m = np.array([length_norm(int(n), n_docs, n_terms) for n in lengths], dtype=np.int64)
        names = list(vocabulary)
        return cls([names[i] for i in by_df], df[by_df], ids, Treap.build(row[term], column, impact(tf, m[column]), max(len(by_df), len(ids))))

    def dump(self) -> bytes:
        t = self.treap
        parts = [b"\n".join(self.terms), self.dfs.astype("<i8").tobytes(), self.ids.astype("<i8").tobytes()]
        parts += [x.tobytes() for mask, drop in zip(t.masks, t.drops, strict=True) for x in (mask, drop)]
        packed = [zstandard.ZstdCompressor(level=1).compress(p) for p in parts]
        head = json.dumps({"height": t.height, "root": t.root, "sizes": [len(p) for p in packed]}).encode()
        return b"".join([len(head).to_bytes(8, "little"), head, *packed])

    @staticmethod
    def _open(uri: str):
        f = open_shared(uri)
        head = json.loads(f.read(int.from_bytes(f.read(8), "little")))
        part = lambda i: zstandard.ZstdDecompressor().decompress(f.read(head["sizes"][i]))
        return f, head, part

    @classmethod
    def frequencies(cls, uri: str) -> tuple[list[bytes], np.ndarray]:
        """Only the head of the file: its terms and in how many documents each occurs."""
        f, _, part = cls._open(uri)
        with f:
            return part(0).split(b"\n"), np.frombuffer(part(1), dtype="<i8")

    @classmethod
    def load(cls, uri: str) -> Shard:
        f, head, part = cls._open(uri)
        with f:
            terms, dfs, ids = part(0).split(b"\n"), np.frombuffer(part(1), dtype="<i8"), np.frombuffer(part(2), dtype="<i8")
            arrays = [np.frombuffer(part(i), dtype=np.uint8 if i % 2 else "<i4") for i in range(3, len(head["sizes"]))]
        return cls(terms, dfs, ids, Treap(head["height"], arrays[::2], arrays[1::2], head["root"]))


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with a term, all their terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            for t in bytes_of(batch.column("text")):
                n = sum(len(words) for words in term_lists(t, LETTERS_AND_DIGITS))
                n_docs += n > 0
                n_terms += n
        yield pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], names=["n_docs", "n_terms"])

    row = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(released(run), "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return row[0] or 0, row[1] or 0


class TreapIndex:
    """Shards in a shared folder; ``shards`` has one row (uri) for each."""

    def __init__(self, shards: DataFrame, n_docs: int, n_terms: int) -> None:
        self.shards, self.n_docs, self.n_terms = shards, n_docs, n_terms


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> TreapIndex:
    """Index every row of ``docs`` with an id. Rows sharing an id are documents of their own; null and empty texts have no terms."""
    spark = docs.sparkSession
    small_batches(spark)
    n_docs, n_terms = corpus_size(docs.filter(F.col(doc_id).isNotNull()), text)
    folder = new_folder(spark, "treaps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: defaultdict = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        words, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.k2t"
            f = AtomicFile(uri)
            f.write(Shard.build(vocabulary, words, ids, n_docs, n_terms).dump())
            f.publish()
            vocabulary.clear()
            words.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([uri])], names=["uri"])

        for batch in row_slices(batches, "text", 1 << 24):
            for i, t in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text")), strict=True):
                own = [np.fromiter(map(vocabulary.__getitem__, part), dtype=np.int32, count=len(part)) for part in term_lists(t, LETTERS_AND_DIGITS)]
                if sum(map(len, own)):
                    words.append(np.concatenate(own))
                    ids.append(i)
                    held += len(words[-1])
                    if held >= shard_words:
                        yield flush()
                        held = 0
        if words:
            yield flush()

    src = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return TreapIndex(cut(src.mapInArrow(released(run), "uri string"), "treap-shards"), n_docs, n_terms)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term) of every item, each term once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [list(dict.fromkeys(w for part in term_lists(t, LETTERS_AND_DIGITS) for w in part)) for t in bytes_of(batch.column("text"))]
            names = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(names)), pa.array([w for x in own for w in x], pa.binary())], names=["item_id", "term"])

    src = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(released(run), f"item_id {src.schema['item_id'].dataType.simpleString()}, term binary").distinct()


def _item_blocks(files: list[str]) -> Iterator[pa.RecordBatch]:
    for uri in files:
        with open_shared(uri) as f:
            yield from pq.ParquetFile(f).iter_batches(ITEM_ROWS)


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """Files of a small table of questions, each read by every shard in blocks."""
    fs, path = pafs.FileSystem.from_uri(folder)
    scheme = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
    return [scheme + x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".parquet")]


def search(index: TreapIndex, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score.

    Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z
    lower-cased; a term counts once in an item. Only scores above 0 are given,
    equal scores by smaller doc_id. Items without a term, or with none that a
    document holds, have no rows. Items sharing an id are one item with the
    terms of all; null ids are left out. Documents sharing an id are ranked one
    by one. Columns not named are left out.
    """
    spark = items.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    folder = new_folder(spark, "treap-items")
    item_terms(items, item_id, text).write.parquet(f"{folder}/terms")
    terms = spark.read.schema(f"item_id {kind}, term binary").parquet(f"{folder}/terms")
    terms.select("term").distinct().write.parquet(f"{folder}/distinct")
    asked = _parts(spark, f"{folder}/distinct")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                names, dfs = Shard.frequencies(uri)
                known = {t: i for i, t in enumerate(names)}
                for block in _item_blocks(asked):
                    found = [t for t in block.column("term").to_pylist() if t in known]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([int(dfs[known[t]]) for t in found], pa.int64())], names=["term", "df"])

    # One shard a task: searching it takes far longer than fetching its name.
    shards = index.shards.repartition(max(1, index.shards.count()))
    df = shards.mapInArrow(released(count), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    held = terms.join(df, "term").groupBy("item_id").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    held.select("item_id", F.col("terms.term").alias("term"), F.col("terms.df").alias("df")).write.parquet(f"{folder}/items")
    blocks = _parts(spark, f"{folder}/items")
    n_docs = index.n_docs

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                shard = Shard.load(uri)
                for block in _item_blocks(blocks):
                    rows, ids, scores = [], [], []
                    for i, (words, dfs) in enumerate(zip(block.column("term").to_pylist(), block.column("df").to_pylist(), strict=True)):
                        here = [(shard.rows[t], weight(n_docs, n)) for t, n in zip(words, dfs, strict=True) if t in shard.rows]
                        if here:
                            pairs = np.array(here, dtype=np.int64)
                            for score, column in shard.treap.search(pairs[:, 0], pairs[:, 1], len(shard.ids), k):
                                rows.append(i)
                                ids.append(int(shard.ids[column]))
                                scores.append(score)
                    yield pa.RecordBatch.from_arrays([block.column("item_id").take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])

    hits = shards.mapInArrow(released(walk), f"item_id {kind}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
