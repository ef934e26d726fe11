"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, keeper): the 128-bit hash of a line key,
in how many documents it was seen and the largest of their ids, bucketed and
sorted by hash. A new batch is reduced to such rows, merge-anti-joined with the
runs to leave out what they settle already (enough documents, a larger keeper),
and added as a run of its own. Two runs of one level are merged into one of the
next level. Batches, runs and merges share one bucketing, so only the reduction
of a batch shuffles.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pandekt.llm.common import bytes_of, new_folder, partitions, released, remove_folder, small_batches

MIN_CHARS = 20
MIN_DOCS = 3
#: Stands for a null document id, which counts as one document before all others.
NULL_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    """The line without outer white space, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _hash(key: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a key of at least ``min_chars`` code points, else None."""
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """Distinct (doc_id, h1, h2) of every row."""
    src = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") >= min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts, found = batch.column("doc_id").to_numpy(), [], []
            for t in bytes_of(batch.column("text")):
                own = {h for x in t.split(b"\n") if (h := _hash(line_key(x), min_chars))}
                counts.append(len(own))
                found.extend(own)
            raw = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, counts)), pa.array(raw[:, 0].copy()), pa.array(raw[:, 1].copy())], names=["doc_id", "h1", "h2"])

    return src.mapInArrow(released(run), "doc_id long, h1 long, h2 long")


class LineRuns:
    """Levelled runs in a shared folder, open to further batches."""

    def __init__(self, spark: SparkSession, folder: str | None = None, min_docs: int = MIN_DOCS) -> None:
        self.spark, self.min_docs = spark, min_docs
        self.folder = folder or new_folder(spark, "line-runs")
        self.buckets = partitions(spark)
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove_folder(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, hashes: DataFrame, distinct: bool = False) -> None:
        """Add a batch of (doc_id, h1, h2). ``distinct``: rows may repeat across the batch."""
        if distinct:
            hashes = hashes.distinct()
        batch = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        for name in self.runs():
            settled = self.spark.table(name).filter(F.col("n_docs") >= self.min_docs).select("h1", "h2", F.col("keeper").alias("_k"))
            batch = batch.join(settled, (batch["h1"] == settled["h1"]) & (batch["h2"] == settled["h2"]) & (settled["_k"] >= batch["keeper"]), "left_anti")
        self._push(0, self._write(batch))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == 2:
            a, b = self.levels[level]
            self.levels[level] = []
            self._push(level + 1, self._merge(a, b))

    def _merge(self, a: str, b: str) -> str:
        """Merge two sorted runs bucket by bucket into one."""
        x, y = self.spark.table(a), self.spark.table(b).select("h1", "h2", F.col("n_docs").alias("_n"), F.col("keeper").alias("_k"))
        both = x.join(y, ["h1", "h2"], "full_outer").select(
            "h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("keeper", "_k").alias("keeper"))
        name = self._write(both)
        self._drop(a)
        self._drop(b)
        return name

    def compact(self) -> DataFrame:
        """Merge all runs into one and return its rows."""
        names = self.runs()
        while len(names) > 1:
            names = [self._merge(names[0], names[1]), *names[2:]]
        self.levels = [*([] for _ in self.levels[1:]), names]
        return self.spark.table(names[0])


def _ranges(docs: DataFrame, doc_id: str, batches: int) -> list:
    """Filters that cut the table into about equal id ranges, largest ids first. Reads the ids only."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    cuts = sorted(set(docs.select(F.col(doc_id).cast("double").alias("d")).approxQuantile("d", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    cuts = [int(c) for c in cuts]
    edges = list(zip([None, *cuts], [*cuts, None], strict=True))
    out = []
    for low, high in reversed(edges):
        if low is None:  # the last batch holds the null ids, too
            out.append(F.lit(True) if high is None else F.col(doc_id).isNull() | (key < high))
        else:
            out.append(F.col(doc_id) >= low if high is None else (F.col(doc_id) >= low) & (F.col(doc_id) < high))
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, batches: int = 4) -> DataFrame:
    """Drop lines found in at least ``min_docs`` documents, except in the largest doc_id holding them.

    Returns doc_id, the ``carry`` columns, text (kept lines joined by line
    ends), n_lines and n_dropped. Null and empty texts are one empty line.
    Rows sharing an id are one document when documents are counted, and each
    keeps its own row; rows with a null id are one document before all others.
    Columns not named are left out, so clashing names do no harm. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    repeated = bool(docs.groupBy(doc_id).count().filter("count > 1").take(1))
    runs = LineRuns(spark, min_docs=min_docs)
    for part in _ranges(docs, doc_id, batches):
        runs.add(line_hashes(docs.filter(part), doc_id, text, min_chars), distinct=repeated)
    runs.compact()
    common = spark.read.schema("h1 long, h2 long, n_docs long, keeper long").parquet(f"{runs.folder}/{runs.runs()[0]}").filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    spark.sql(f"DROP TABLE {runs.runs()[0]}")
    # Both sides are plain exchanges: a line that many documents hold is split by the skew join.
    hits = line_hashes(docs, doc_id, text, min_chars).join(common, ["h1", "h2"]).filter(F.col("doc_id") != F.col("keeper"))
    drops = hits.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set(F.struct("h1", "h2")).alias("_drop"))
    src = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_d"), F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"),
                      *[F.col(c).alias(f"_c_{c}") for c in carry])
    joined = src.join(drops, "_d", "left")
    names = ["_id", *[f"_c_{c}" for c in carry]]
    schema = ", ".join(f"`{n}` {joined.schema[n].dataType.simpleString()}" for n in names) + ", text string, n_lines long, n_dropped long"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts, n_lines, n_dropped = [], [], []
            for t, drop in zip(bytes_of(batch.column("_t")), batch.column("_drop").to_pylist(), strict=True):
                lines = t.split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    gone = {np.array([d["h1"], d["h2"]], dtype="<i8").tobytes() for d in drop}
                    lines = [x for x in lines if _hash(line_key(x), min_chars) not in gone]
                    t = b"\n".join(lines)
                texts.append(t)
                n_dropped.append(n_lines[-1] - len(lines))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                             names=[*names, "text", "n_lines", "n_dropped"])

    out = joined.select(*names, "_t", "_drop").mapInArrow(released(run), schema)
    return out.select(F.col("_id").alias("doc_id"), *[F.col(f"_c_{c}").alias(c) for c in carry], "text", "n_lines", "n_dropped")
