"""Packing documents into windows of near-equal length by multiway differencing.

A document is cut into spans: full windows first, the rest into equal spans of
at most ``max_span`` tokens. Full windows stand alone. The other spans are dealt
to windows block by block with the Karmarkar-Karp method: every span starts as
a partial partition of its own, and the two partial partitions with the largest
spread are merged so that the heavy windows of one meet the light windows of
the other. Where a window exceeds the capacity, the block is dealt again to
more windows.

No shuffle is needed: a block is a run of rows of one input partition, bounded
in tokens, so neither a hot source nor a very long document grows a task.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pandekt.llm.common import released, small_batches
from pandekt.llm.tokens import CACHE_ENTRIES, encoder

CAPACITY = 2048
MAX_SPAN = 384
BLOCK_WINDOWS = 192
SLICE_BYTES = 4 << 20


def difference_partition(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of every item by multiway Karmarkar-Karp differencing."""
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    sums: list[np.ndarray | None] = []
    heap = []
    for i, size in enumerate(sizes.tolist()):
        s = np.zeros(windows, dtype=np.int64)
        s[0] = size
        sums.append(s)
        heap.append((-size, i))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[a] = sums[b] = None
        merges.append((a, b, order))
        sums.append(total)
        heapq.heappush(heap, (int(total[-1] - total[0]), len(sums) - 1))
    # Back from the last merge: the final window of every slot of every part.
    label: dict[int, np.ndarray] = {heap[0][1]: np.arange(windows)}
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        own = label.pop(n + k)
        for part, slots in ((a, order), (b, windows - 1 - order)):
            at = np.empty(windows, dtype=np.int64)
            at[slots] = own
            label[part] = at
    return np.array([label[i][0] for i in range(n)], dtype=np.int64)


def deal(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of at most ``capacity``: start from the fewest possible, add windows while one overflows."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    windows = -(-int(sizes.sum()) // capacity)
    while True:
        window = difference_partition(sizes, windows)
        if np.bincount(window, weights=sizes, minlength=windows).max() <= capacity:
            return window
        windows += max(1, windows // 256)


def spans(n_tokens: int, capacity: int, max_span: int) -> list[tuple[int, int]]:
    """(start, length) of the spans of one document; lengths of cut rests differ by one at most."""
    full = n_tokens // capacity
    out = [(k * capacity, capacity) for k in range(full)]
    rest, start = n_tokens - full * capacity, full * capacity
    parts = -(-rest // max_span)
    for k in range(parts):
        length = rest * (k + 1) // parts - rest * k // parts
        out.append((start, length))
        start += length
    return out


OUTPUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1,
                   capacity: int = CAPACITY, max_span: int = MAX_SPAN, block_windows: int = BLOCK_WINDOWS,
                   with_ids: bool = True, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row per span: where it lies in its document and in its window, and its ids.

    ``ids`` holds little-endian unsigned 32-bit ids (null with ``with_ids=False``).
    Null and empty texts give one span with the end id. Null document ids, tied
    ids and repeated rows are packed row by row like any other. Other columns
    are ignored, whatever their names. An empty table gives no rows. A sequence
    number is the partition number (high bits) and a running number inside it.
    ``cache_entries`` sizes the cache of encoded pieces in each worker.
    """
    if not 0 < max_span <= capacity:
        raise ValueError("max_span must lie between 1 and the capacity")
    small_batches(docs.sparkSession)
    limit = block_windows * capacity
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer_path, cache_entries)
        base = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        tokens = 0
        number = 0

        def close() -> pa.RecordBatch:
            nonlocal held, tokens, number
            length = np.array([x[2] for x in held], dtype=np.int64)
            full = length == capacity
            window = np.empty(len(held), dtype=np.int64)
            window[full] = np.arange(int(full.sum()))
            window[~full] = deal(length[~full], capacity) + int(full.sum())
            order = np.argsort(window, kind="stable")
            w, n = window[order], length[order]
            before = np.cumsum(n) - n
            first = np.r_[True, w[1:] != w[:-1]]
            offset = before - np.maximum.accumulate(np.where(first, before, 0))
            col = lambda k: [held[i][k] for i in order]
            out = pa.RecordBatch.from_arrays([
                pa.array(col(0), pa.int64()), pa.array(col(1), pa.int64()), pa.array(n), pa.array(col(3), pa.int64()), pa.array(col(4), pa.int64()),
                pa.array(base + number + np.cumsum(first) - 1), pa.array(offset), pa.array(col(5) if with_ids else [None] * len(held), pa.binary()),
            ], names=schema)
            number += int(first.sum())
            held, tokens = [], 0
            return out

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, batch.num_rows, 512):
                for name, ids in zip(names[at:at + 512], code.encode_many(texts.slice(at, 512).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start, length in spans(n, capacity, max_span):
                        own = ids[4 * start:4 * (start + length)]
                        held.append((name, start, length, zlib.crc32(own), n, own if with_ids else None))
                        tokens += length
                        if tokens >= limit:
                            yield close()
        if held:
            yield close()

    return src.mapInArrow(released(run), OUTPUT)
