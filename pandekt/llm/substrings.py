"""Substring dedup by relative Lempel-Ziv parsing against an indexed corpus.

The reference is the corpus itself: a document may point to any earlier place.
Its index is dealt into blocks by content. A phrase is a run of consecutive
window starts whose windows share their least k-gram (the anchor); equal windows
have equal anchors, so every place a window could copy lies in the block of its
anchor, and a document is looked up in every block that can hold a match of it.

1. Whole phrases: inside a block, a phrase that stands somewhere earlier refers
   to its earliest place. In a copied passage such phrases follow one another.
2. Factor boundaries: where a copy departs from its reference, an anchor has
   phrases of different content. Only the earliest place of each of these is
   looked at again, window by window.
3. A document's parse takes its references from left to right and greedily
   extends a factor for as long as the place referred to goes on. A factor is
   at least ``window`` words long; its words are the duplicate span.

Copies inside one slice of a map task are settled there: a phrase found in
thousands of documents sends one row per slice to its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pandekt.llm.common import HASH_BYTES, SPACE, bytes_of, cut, mix64, released, row_slices, small_batches
from pandekt.llm.common import _BYTE_VALUES, _power_tables

WINDOW = 20
#: Words of an anchor: shorter ones make fewer phrases and more phrases that meet by chance.
ANCHOR = 8
SLICE_BYTES = 1 << 23
#: Stands for a null document id, which comes before all others.
NULL_ID = -(1 << 63)
#: A phrase's place: start << 8 | windows << 2 | state.
OCCURS, REPEATS, SETTLED = 0, 1, 2


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, unchanged, and the number of words of each."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    edge = np.diff(np.r_[True, SPACE[buf]].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    codes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    for last in np.searchsorted(starts, np.arange(HASH_BYTES, len(buf) + HASH_BYTES, HASH_BYTES)).tolist():
        if last > first:
            low, high = int(starts[first]), int(ends[last - 1])
            p, q = _power_tables(high - low)
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[buf[low:high]] * p[: high - low], out=sums[1:])
            codes[first:last] = mix64((sums[ends[first:last] - low] - sums[starts[first:last] - low]) * q[starts[first:last] - low])
        first = last
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return codes, np.diff(np.r_[0, np.searchsorted(starts, text_ends)])


class Windows:
    """Hashes of word sequences of the documents of one slice, laid end to end."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        codes, self.n_words = word_codes(texts)
        self.first = np.cumsum(self.n_words) - self.n_words
        p, self._back = _power_tables(len(codes) + 1)
        self._sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * p[: len(codes)], out=self._sums[1:])
        counts = np.maximum(self.n_words - window + 1, 0)
        #: Document and word position of every window.
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + self.first[self.doc]

    def hashes(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return mix64((self._sums[at + n] - self._sums[at]) * self._back[at] + np.asarray(n, dtype=np.uint64))

    def anchors(self, window: int, k: int) -> np.ndarray:
        """Least k-gram of every window."""
        grams = self.hashes(np.arange(max(len(self._sums) - k, 0)), k)
        span = window - k + 1
        width = 1
        while width * 2 <= span:
            grams = np.minimum(grams[:-width], grams[width:])
            width *= 2
        return np.minimum(grams[self.at], grams[self.at + span - width])


def _phrases(w: Windows, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor, content, repeats itself) of every phrase."""
    anchor = w.anchors(window, k)
    new = np.r_[True, (np.diff(w.at) != 1) | (np.diff(w.doc) != 0) | (anchor[1:] != anchor[:-1])]
    first = np.flatnonzero(new)
    # In text that repeats itself an anchor may go on for ever: a phrase has at most ``window`` windows.
    n = np.diff(np.r_[first, len(new)])
    new |= (np.arange(len(new)) - np.repeat(first, n)) % window == 0
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(new)])
    own = w.hashes(w.at, window)
    phrase = np.cumsum(new) - 1
    repeats = np.zeros(len(first), dtype=bool)
    for d in range(1, min(window, int(n.max(initial=0)))):
        same = np.flatnonzero(own[d:] == own[:-d])
        same = same[phrase[same] == phrase[same + d]]
        repeats[phrase[same]] = True
    return first, n, anchor[first], w.hashes(w.at[first], n + window - 1), repeats


PLACE = "anchor long, content long, doc long, row long, place long, ref long"


def _settle(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    """Rows of PLACE. Later places of a phrase inside the slice become SETTLED, refer to the first one and need no block any more.

    A settled row carries the document and start it refers to in ``content`` and ``ref``.
    """
    anchor, content = anchor.view(np.int64).copy(), content.view(np.int64).copy()
    ref = np.zeros(len(anchor), dtype=np.int64)
    order = np.lexsort((start, doc, content, anchor))
    a, c, d, s = anchor[order], content[order], doc[order], start[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])] if len(a) else np.zeros(0, dtype=bool)
    lead = np.flatnonzero(new)
    lead = np.repeat(lead, np.diff(np.r_[lead, len(a)]))
    # Rows that share an id and a start are at one place.
    later = (d != d[lead]) | (s != s[lead])
    done = order[later]
    content[done], ref[done] = d[lead][later], s[lead][later]
    state[done] = SETTLED
    anchor[done] = mix64(done.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + anchor[done].view(np.uint64)).view(np.int64)
    place = start << 8 | n << 2 | state
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, content, doc, row, place, ref)], names=["anchor", "content", "doc", "row", "place", "ref"])


def phrases(docs: DataFrame, window: int, k: int) -> DataFrame:
    """PLACE rows of all phrases. ``docs`` has doc, row and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text", SLICE_BYTES):
            w = Windows(bytes_of(batch.column("text")), window)
            if len(w.at):
                first, n, anchor, content, repeats = _phrases(w, window, k)
                at = w.doc[first]
                doc, row = batch.column("doc").to_numpy()[at], batch.column("row").to_numpy()[at]
                yield _settle(anchor, content, doc, row, w.at[first] - w.first[at], n, np.where(repeats, REPEATS, OCCURS).astype(np.int64))

    return docs.mapInArrow(released(run), PLACE)


def single_windows(docs: DataFrame, window: int) -> DataFrame:
    """PLACE rows of the windows asked for. ``docs`` has doc, row, text and places (of phrases)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text", SLICE_BYTES):
            w = Windows(bytes_of(batch.column("text")), window)
            asked = batch.column("places")
            place = asked.flatten().to_numpy().astype(np.int64)
            at = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            start, n = place >> 8, place >> 2 & 63
            at, start = np.repeat(at, n), np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if len(at):
                own = w.hashes(w.first[at] + start, window)
                one = np.ones(len(at), dtype=np.int64)
                yield _settle(own, own, batch.column("doc").to_numpy()[at], batch.column("row").to_numpy()[at], start, one, one * OCCURS)

    return docs.mapInArrow(released(run), PLACE)


def looked_up(places: DataFrame) -> DataFrame:
    """Every block's answer: (doc, row, start, n, ref_doc, ref_start, again).

    Places that are not the earliest of their phrase refer to it. ``again``
    marks earliest places of an anchor that has phrases of different content,
    or of a phrase that repeats a window; they refer to nothing.
    """
    settled = F.col("place").bitwiseAND(3) == SETTLED
    start = F.shiftright("place", 8)
    blocks = places.repartition("anchor")
    same = Window.partitionBy("anchor", "content").orderBy("doc", "place")
    anchor = Window.partitionBy("anchor").orderBy("content", "doc", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = blocks.select("*", F.first("doc").over(same).alias("_d"), F.first("place").over(same).alias("_p"),
                           (F.first("content").over(anchor) != F.last("content").over(anchor)).alias("_many"))
    lead_start = F.shiftright("_p", 8)
    later = (F.col("doc") != F.col("_d")) | (start != lead_start)
    out = ranked.select("doc", "row", start.alias("start"), F.shiftright("place", 2).bitwiseAND(63).alias("n"),
                        F.when(settled, F.col("content")).when(later, F.col("_d")).alias("ref_doc"), F.when(settled, F.col("ref")).when(later, lead_start).alias("ref_start"),
                        (~settled & ~later & (F.col("_many") | (F.col("place").bitwiseAND(3) == REPEATS))).alias("again"))
    return out.filter(F.col("again") | F.col("ref_doc").isNotNull())


def greedy_factors(start: np.ndarray, n: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(start, words, ref_doc, ref_start) of every factor, from the references of one document."""
    out: list[tuple[int, int, int, int]] = []
    order = np.argsort(start, kind="stable")
    for s, k, d, r in zip(*(x[order].tolist() for x in (start, n, ref_doc, ref_start)), strict=True):
        if out:
            s0, words, d0, r0 = out[-1]
            if d == d0 and r - s == r0 - s0 and s <= s0 + words - window + 1:
                out[-1] = (s0, max(words, s + k + window - 1 - s0), d0, r0)
                continue
        out.append((s, k + window - 1, d, r))
    return out


def _keyed(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc, row, text and carried columns; ``row`` tells rows apart that share an id."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    repeated = bool(docs.groupBy(key.alias("k")).count().filter("count > 1").take(1))
    row = F.xxhash64(F.col(text)) if repeated else F.lit(0).cast("long")
    return docs.select(key.alias("doc"), row.alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(doc_id).alias("_id"), *[F.col(c).alias(f"_c_{c}") for c in carry])


def references(keyed: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc, row, start, n, ref_doc, ref_start): windows from ``start`` that stand at ``ref_start`` of ``ref_doc``, too, which is earlier."""
    src = keyed.select("doc", "row", "text")
    found = cut(looked_up(phrases(src, window, k)), "phrase-references")
    again = found.filter("again").groupBy("doc", "row").agg(F.collect_list(F.shiftleft("start", 8) + F.shiftleft("n", 2)).alias("places"))
    singles = looked_up(single_windows(src.join(again, ["doc", "row"]), window))
    return found.filter(~F.col("again")).drop("again").unionByName(singles.filter(~F.col("again")).drop("again"))


def _with_references(keyed: DataFrame, window: int, k: int) -> DataFrame:
    refs = references(keyed, window, k).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n", "ref_doc", "ref_start")).alias("refs"))
    refs = refs.select("doc", "row", *[F.col(f"refs.{c}").alias(c) for c in ("start", "n", "ref_doc", "ref_start")])
    return keyed.join(refs, ["doc", "row"], "left")


def _own_factors(batch: pa.RecordBatch, window: int) -> Iterator[list[tuple[int, int, int, int]]]:
    columns = [batch.column(c) for c in ("start", "n", "ref_doc", "ref_start")]
    for i in range(batch.num_rows):
        values = [c[i].values for c in columns]
        yield greedy_factors(*(v.to_numpy().astype(np.int64) for v in values), window) if values[0] is not None else []


def factors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """The parse: doc_id, start, n_words, ref_doc (null: a document without id) and ref_start of every factor of ``window`` or more words."""
    small_batches(docs.sparkSession)
    joined = _with_references(_keyed(docs, doc_id, text), window, k)
    kind = joined.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(_own_factors(batch, window))
            names = batch.column("_id").take(pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own])))
            cells = np.array([f for x in own for f in x], dtype=np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([names, *[pa.array(c) for c in cells]], names=["doc_id", "start", "n_words", "ref_doc", "ref_start"])

    out = joined.select("_id", "start", "n", "ref_doc", "ref_start").filter("start IS NOT NULL").mapInArrow(released(run), f"doc_id {kind}, start long, n_words long, ref_doc long, ref_start long")
    return out.withColumn("ref_doc", F.when(F.col("ref_doc") != NULL_ID, F.col("ref_doc")))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """Remove words covered by a window of ``window`` words that also starts earlier.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Earlier is a smaller doc_id,
    or the same document at a smaller position; windows are judged on the input.
    Returns doc_id, the ``carry`` columns, text (kept words joined by one space),
    n_words, n_removed and spans (start and length of every factor, in order).
    Null and empty texts have no words. Rows sharing an id are one document
    for the order: a window at the same position of both is not earlier. A null
    id comes before all others. Columns not named are left out. An empty table
    gives no rows. Sequences are compared by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    joined = _with_references(_keyed(docs, doc_id, text, carry), window, k)
    names = ["_id", *[f"_c_{c}" for c in carry]]
    schema = ", ".join(f"`{n}` {joined.schema[n].dataType.simpleString()}" for n in names) + ", text string, n_words long, n_removed long, spans array<struct<start: long, n_words: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed, spans = [], [], [], []
            for t, own in zip(bytes_of(batch.column("text")), _own_factors(batch, window), strict=True):
                words = t.split()
                n_words.append(len(words))
                if own:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    cells = np.array(own, dtype=np.int64)
                    np.add.at(edge, cells[:, 0], 1)
                    np.add.at(edge, cells[:, 0] + cells[:, 1], -1)
                    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    n_removed.append(len(words) - len(kept))
                    words = [words[i] for i in kept.tolist()]
                else:
                    n_removed.append(0)
                texts.append(b" ".join(words))
                spans.append([{"start": f[0], "n_words": f[1]} for f in own])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())])))], names=[*names, "text", "n_words", "n_removed", "spans"])

    out = joined.select(*names, "text", "start", "n", "ref_doc", "ref_start").mapInArrow(released(run), schema)
    return out.select(F.col("_id").alias("doc_id"), *[F.col(f"_c_{c}").alias(c) for c in carry], "text", "n_words", "n_removed", "spans")
