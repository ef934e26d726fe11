"""Helpers shared by the corpus operators: tables, shared storage, byte hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from pandekt.session import shared_dir, spread

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Let all cores work on a table that arrives as a few small files."""
    return spread(df, key)


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of an unused folder below the folder all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: later work starts from files that outlive executors."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, label: str) -> DataFrame:
    return written(df, new_folder(df.sparkSession, label))


def remove_folder(spark: SparkSession, uri: str) -> None:
    """Delete a scratch folder this package made."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class AtomicFile:
    """A file in shared storage that appears under its name only when complete.

    Every attempt of a task writes its own temporary name and moves it, so a
    repeated or speculative attempt replaces the file by equal bytes.
    """

    def __init__(self, uri: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.temporary = f"{self.path}.attempt-{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def publish(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.path)

    def discard(self) -> None:
        self.stream.close()
        self.fs.delete_file(self.temporary)


def open_shared(uri: str) -> pa.NativeFile:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of at most BATCH_ROWS rows.

    The default of 10,000 rows is made for numbers; with texts each batch takes
    tens of MB in the JVM and again in the worker. Lowers the session's setting
    and leaves lower ones alone; results don't depend on it.
    """
    if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS or int(spark.conf.get(BATCH_CONF)) <= 0:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def released(run):
    """Wrap a map over batches so that its worker gives free memory back when the task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # glibc only
                trim(0)

    return wrapped


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives empty bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return [v if v is not None else b"" for v in column.to_pylist()]


def row_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` text bytes, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cell = np.cumsum(lengths) // limit
        cuts = np.flatnonzero(np.diff(cell)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wraps around silently)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


HASH_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("p", _BASE), ("q", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"], _powers["q"]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(texts: list[bytes], separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text, A-Z lower-cased, as 64-bit hashes.

    By default words are ``[^\\x20\\x09-\\x0D]+``; line ends must be separators.

    Returns (hashes, words per text, buffer, word starts, word ends); array
    arithmetic over the joined bytes, no object per word. Hashes are made for
    runs of HASH_BYTES, so that the working arrays stay small at any input.
    """
    joined = b"\n".join(texts) + b"\n"
    buf = LOWER[np.frombuffer(joined, dtype=np.uint8)]
    space = separators[buf]
    edge = np.diff(np.r_[True, space].astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    hashes = np.empty(len(starts), dtype=np.uint64)
    cuts = np.searchsorted(starts, np.arange(HASH_BYTES, len(buf) + HASH_BYTES, HASH_BYTES))
    first = 0
    for last in cuts.tolist():
        if last > first:
            low, high = int(starts[first]), int(ends[last - 1])
            p, q = _power_tables(high - low)
            with np.errstate(over="ignore"):
                sums = np.zeros(high - low + 1, dtype=np.uint64)
                np.cumsum(_BYTE_VALUES[buf[low:high]] * p[: high - low], out=sums[1:])
                hashes[first:last] = mix64((sums[ends[first:last] - low] - sums[starts[first:last] - low]) * q[starts[first:last] - low])
        first = last
    text_ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    upto = np.searchsorted(starts, text_ends)
    return hashes, np.diff(np.r_[0, upto]), buf, starts, ends
