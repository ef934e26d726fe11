"""Token ids in raw shard files, with keyed access through a minimal perfect hash.

Shard file: magic ``PKTOK001``, the ids back to back (unsigned 16-bit where the
vocabulary allows, else 32-bit, little-endian), and a 24-byte footer (id width,
number of ids, magic). Shards hold consecutive ranges of keys in order.

Index: keys are hashed to buckets; a bucket is one row with a minimal perfect
hash over its keys (levels of bit sets: a key settles on the first level where
nobody shares its bit; its rank among set bits is its slot) and, per slot, a
32-bit fingerprint, the shard, the offset and the length. A lookup hashes once,
probes a few bits and compares the fingerprint.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pandekt.llm.common import AtomicFile, mix64, new_folder, open_shared, partitions, released, small_batches, written
from pandekt.llm.tokens import encoder

MAGIC = b"PKTOK001"
FOOTER = "<qq8s"
FOOTER_BYTES = struct.calcsize(FOOTER)
BUCKET_KEYS = 50_000
MAX_LEVELS = 64


def id_width(tokenizer_path: str) -> int:
    """2 bytes where every id fits, else 4."""
    return 2 if encoder(tokenizer_path).tokenizer.get_vocab_size() <= 1 << 16 else 4


# Minimal perfect hash over 128-bit key digests.

def digests(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode()) for k in keys), dtype="<u8").reshape(-1, 2)
    return raw[:, 0].copy(), raw[:, 1].copy()


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(h1 + h2 * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)


def build_hash(h1: np.ndarray, h2: np.ndarray, gamma: float = 2.0) -> tuple[list[int], bytes, np.ndarray]:
    """(level sizes in bits, packed bits, slot of every key). Equal digests can't be told apart and raise."""
    sizes, bits, rest = [], [], np.arange(len(h1))
    level_of, place_of = np.zeros(len(h1), dtype=np.int64), np.zeros(len(h1), dtype=np.int64)
    while len(rest):
        level = len(sizes)
        if level == MAX_LEVELS:
            raise ValueError("keys with equal digests can't be indexed")
        size = -(-max(64, int(gamma * len(rest))) // 8) * 8
        place = _place(h1[rest], h2[rest], level, size)
        alone = np.bincount(place, minlength=size) == 1
        settled = alone[place]
        level_of[rest[settled]], place_of[rest[settled]] = level, place[settled]
        sizes.append(size)
        bits.append(alone)
        rest = rest[~settled]
    if not sizes:
        return [], b"", np.zeros(0, dtype=np.int64)
    flat = np.concatenate(bits)
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    rank = np.cumsum(flat) - 1
    return sizes, np.packbits(flat, bitorder="little").tobytes(), rank[base[level_of] + place_of]


def find_slots(sizes: list[int], packed: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Slot of every key, -1 where no level has its bit."""
    flat = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), bitorder="little")
    rank = np.cumsum(flat) - 1
    slot, rest, base = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        at = base + _place(h1[rest], h2[rest], level, size)
        hit = flat[at] == 1
        slot[rest[hit]] = rank[at[hit]]
        rest, base = rest[~hit], base + size
    return slot


# Writing.

def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
                 end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encode every text, write the shard files and return one entry per document.

    Entries: doc_id, nth (0 for the first row of an id, 1 for the next ...),
    shard, start (ids before it in the shard), n_tokens. Rows follow doc_id
    (nulls first, ties by text), so equal ids share a shard. The entries are
    written as well: the files are made exactly once, by this call.
    """
    spark = docs.sparkSession
    small_batches(spark)
    width = id_width(tokenizer_path)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged = src.repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        code, out, total, last, nth = encoder(tokenizer_path), None, 0, object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = AtomicFile(shard_uri(folder, shard))
                out.write(MAGIC)
            names, counts, ordinals = batch.column("doc_id").to_pylist(), [], []
            for at in range(0, batch.num_rows, 512):
                for ids in code.encode_many(batch.column("text").slice(at, 512).to_pylist()):
                    ids += end
                    counts.append(len(ids) // 4)
                    out.write(np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() if width == 2 else ids)
            for name in names:
                nth = nth + 1 if name == last else 0
                last = name
                ordinals.append(nth)
            n = np.array(counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(ordinals, pa.int64()), pa.array([shard] * len(n), pa.int64()), pa.array(total + np.cumsum(n) - n), pa.array(n)],
                names=["doc_id", "nth", "shard", "start", "n_tokens"])
            total += int(n.sum())
        if out is not None:
            out.write(struct.pack(FOOTER, width, total, MAGIC))
            out.publish()

    return written(ranged.mapInArrow(released(run), "doc_id long, nth long, shard long, start long, n_tokens long"), f"{folder}/entries")


def shard_uri(folder: str, shard: int) -> str:
    return f"{folder}/shards/shard-{shard:06d}.ids"


def _key(doc_id: str, nth: str):
    return F.concat_ws("#", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(nth).cast("string"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("key"), F.lit(buckets))


def write_index(entries: DataFrame, folder: str, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """Minimal perfect hash over (doc_id, nth), one row per bucket; returns (index, number of buckets)."""
    buckets = max(1, -(-entries.count() // bucket_keys))
    keyed = entries.select(_key("doc_id", "nth").alias("key"), "shard", "start", "n_tokens").withColumn("bucket", _bucket(buckets))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = digests(pdf["key"].tolist())
        sizes, bits, slot = build_hash(h1, h2)
        back = np.argsort(slot)
        raw = lambda values, kind: np.asarray(values)[back].astype(kind).tobytes()
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "levels": [sizes], "bits": [bits], "fingerprints": [raw(h2 & np.uint64(0xFFFFFFFF), "<u4")],
                             "shards": [raw(pdf["shard"], "<u4")], "starts": [raw(pdf["start"], "<u8")], "counts": [raw(pdf["n_tokens"], "<u8")]})

    index = keyed.groupBy("bucket").applyInPandas(
        build, "bucket long, levels array<long>, bits binary, fingerprints binary, shards binary, starts binary, counts binary")
    return written(index, f"{folder}/index"), buckets


# Reading.

def lookup(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Place of every (doc_id, nth) through the index; unknown keys give no row."""
    keyed = keys.select("doc_id", "nth", _key("doc_id", "nth").alias("key")).withColumn("bucket", _bucket(buckets))

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="Int64") for c in ("doc_id", "nth", "shard", "start", "n_tokens")})
        row = right.iloc[0]
        h1, h2 = digests(left["key"].tolist())
        slot = find_slots(list(row["levels"]), row["bits"], h1, h2)
        prints = np.frombuffer(row["fingerprints"], dtype="<u4")
        ok = (slot >= 0) & (prints[np.maximum(slot, 0)] == (h2 & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        at = slot[ok]
        return pd.DataFrame({"doc_id": left["doc_id"].astype("Int64")[ok].array, "nth": left["nth"].to_numpy()[ok], "shard": np.frombuffer(row["shards"], dtype="<u4")[at].astype(np.int64),
                             "start": np.frombuffer(row["starts"], dtype="<u8")[at].astype(np.int64), "n_tokens": np.frombuffer(row["counts"], dtype="<u8")[at].astype(np.int64)})

    return keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(probe, "doc_id long, nth long, shard long, start long, n_tokens long")


def check_footer(stream: pa.NativeFile) -> tuple[int, int]:
    """(id width, number of ids) of an open shard; raises on a file that isn't whole."""
    size = stream.size()
    stream.seek(size - FOOTER_BYTES)
    width, total, magic = struct.unpack(FOOTER, stream.read(FOOTER_BYTES))
    stream.seek(0)
    if magic != MAGIC or stream.read(len(MAGIC)) != MAGIC or size != len(MAGIC) + width * total + FOOTER_BYTES:
        raise ValueError("not a complete shard file")
    return width, total


def read_ids(places: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Read the ids at (shard, start, n_tokens): adds ``ids_crc32`` and ``ids`` (little-endian 32-bit).

    Places of one shard are read in file order by one task; each read is a seek
    and a bounded read of one document.
    """
    spark = places.sparkSession
    ordered = places.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, current, width = None, None, 0
        for batch in batches:
            crcs, blobs = [], []
            for shard, start, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "n_tokens")), strict=True):
                if shard != current:
                    if stream is not None:
                        stream.close()
                    stream, current = open_shared(shard_uri(folder, shard)), shard
                    width, _ = check_footer(stream)
                stream.seek(len(MAGIC) + width * start)
                raw = stream.read(width * n)
                ids = raw if width == 4 else np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes()
                if len(ids) != 4 * n:
                    raise ValueError("shard file ends early")
                crcs.append(zlib.crc32(ids))
                blobs.append(ids if with_ids else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "nth", "shard", "start", "n_tokens")), pa.array(crcs, pa.int64()), pa.array(blobs, pa.binary())],
                                             names=["doc_id", "nth", "shard", "start", "n_tokens", "ids_crc32", "ids"])
        if stream is not None:
            stream.close()

    return ordered.mapInArrow(released(run), "doc_id long, nth long, shard long, start long, n_tokens long, ids_crc32 long, ids binary")


def document_keys(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, nth) of every row: ids are counted first, so a repeated id is no hot group."""
    counted = docs.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("nth"))


class TokenStore:
    """A folder with shards, entries and index."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    @property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")

    def get(self, keys: DataFrame, with_ids: bool = True) -> DataFrame:
        """Rows for the (doc_id, nth) keys, with ``start`` counted over all shards."""
        found = read_ids(lookup(keys, self.index, self.buckets), self.folder, with_ids)
        entries = self.spark.read.parquet(f"{self.folder}/entries")
        # One row per shard; the window runs over shards, not documents.
        totals = entries.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
        before = totals.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before"))
        return found.join(before, "shard").select("doc_id", "nth", (F.col("_before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "ids")


def write_store(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
                folder: str | None = None, shards: int | None = None, bucket_keys: int = BUCKET_KEYS) -> TokenStore:
    """Write shards and index of all documents.

    Null texts count as empty and hold the end id only; null ids are stored
    first and found under the key null; repeated ids are told apart by ``nth``
    in the order of their texts. Other columns are ignored. An empty table
    makes no shard and an empty index.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-store")
    entries = write_shards(docs, folder, tokenizer_path, doc_id, text, end_id, shards)
    _, buckets = write_index(entries, folder, bucket_keys)
    return TokenStore(spark, folder, buckets)
