"""N-gram Jaccard join by prefix trees, one row per document.

1. Every text becomes its set of word shingles (64-bit hashes; their numeric
   order is the global order). Documents with equal sets are one class.
2. Routing. Two sets of Jaccard similarity t differ in at most
   ``(1 - t) / (1 + t) * (|x| + |y|)`` elements. The shingle space is cut into
   more segments than that, so linked sets agree on a whole segment, and only
   sets sharing one meet. Inside such a meeting, sets whose sketches agree in
   ``agree`` of 64 bytes are tied; ties make clusters. A linked pair of large sets
   agrees in 80 % of the bytes on average at a similarity of 0.80; with 24 bytes such
   a pair stays untied with a probability of 2e-14 (6e-19 at 0.85), and is lost
   unless other sets tie the two. ``agree=0`` ties all sets that meet: no pair is lost.
3. Join. The sets of a cluster are dealt to blocks and every pair of blocks is
   joined: one block is stored in a prefix tree over the globally ordered sets;
   all sets of the other block walk it at once, sharing the overlaps counted on
   common prefixes, and drop out of a subtree when the lengths left can't reach
   the threshold. What reaches a leaf is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pandekt.llm.common import bytes_of, cut, mix64, partitions, released, row_slices, small_batches, word_hashes
from pandekt.llm.components import components, union_roots

SLICE_BYTES = 2 << 20
SKETCH = 64
#: Sketch bytes in which two sets must agree to be joined; 0 joins all that meet.
AGREE = 24
CLASS_RATIO = 1.5
BLOCK_SETS = 256
BLOCK_SHINGLES = 64_000
MEETING = 1024
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


# Shingle sets.

def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(all sets one after the other, each sorted and distinct; size of every set)."""
    h, n, *_ = word_hashes(texts)
    if not len(h):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    with np.errstate(over="ignore"):
        at = np.arange(len(h), dtype=np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        last = np.cumsum(n)[doc]
        # A shingle starts at every word with enough words after it; a shorter text is one shingle.
        width = np.minimum(words, n[doc])
        start = at + width <= last
        start &= (n[doc] >= words) | (at == last - n[doc])
        value = np.zeros(len(h), dtype=np.uint64)
        for k in range(words):
            use = k < width
            value[use] += mix64(h[np.minimum(at + k, len(h) - 1)[use]] + _ODD[0] * np.uint64(k + 1))
        value = mix64(value + width.astype(np.uint64) * _ODD[1])[start]
    doc = doc[start]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]
    return value[keep], np.bincount(doc[keep], minlength=len(texts))


def set_hashes(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of every set, as two signed columns."""
    first = np.r_[0, np.cumsum(sizes)]
    with np.errstate(over="ignore"):
        sums = [np.r_[np.uint64(0), np.cumsum(mix64(values + c), dtype=np.uint64)] for c in (_ODD[2], _ODD[3])]
        h1, h2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
    return h1, h2


def largest_difference(low_sum: float, per_cent: int) -> int:
    """Most elements two sets of together ``low_sum`` elements may differ in at that similarity."""
    return int(low_sum * (100 - per_cent) / (100 + per_cent) + 1e-9)


def size_classes(per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper bounds of the size classes, segments of each): more segments than any linked pair of it may differ in."""
    bounds, hi = [], 6.0
    while hi < 1e12:
        hi = np.ceil(hi * CLASS_RATIO)
        bounds.append(hi)
    upper = np.array(bounds)
    differ = np.array([largest_difference(h * (1 + 100 / per_cent), per_cent) for h in upper])
    return upper, np.ceil((differ + 1) * 1.2).astype(np.int64)


def signatures(values: np.ndarray, sizes: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) pairs: one per filled segment of a set, in its class and, near a class's lower end, the class below."""
    upper, segments = size_classes(per_cent)
    differ = np.array([largest_difference(h * (1 + 100 / per_cent), per_cent) for h in upper])
    own = np.searchsorted(upper, sizes, side="right")
    rows, out = [], []
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    for shift in (0, 1):
        cls = own - shift
        use = sizes > 0
        if shift:  # a smaller partner may lie in the class below
            use &= (cls >= 0) & (np.ceil(sizes * per_cent / 100) < upper[np.maximum(cls, 0)])
        pick = use[row_of]
        if not pick.any():
            continue
        r, v = row_of[pick], values[pick]
        m = segments[cls[r]].astype(np.uint64)
        with np.errstate(over="ignore"):
            seg = ((mix64(v + _ODD[2]) >> np.uint64(20)) % m).astype(np.int64)
            base = np.r_[0, np.cumsum(np.where(use, segments[np.maximum(cls, 0)], 0))]
            cell = base[r] + seg
            order = np.argsort(cell, kind="stable")
            cell, content = cell[order], mix64(v[order])
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            total = np.add.reduceat(content, first)
            cell = cell[first]
            row = np.searchsorted(base, cell, side="right") - 1
            key = mix64(total + mix64((cell - base[row]).astype(np.uint64) * _ODD[3] + cls[row].astype(np.uint64) * _ODD[4]))
        rows.append(row)
        out.append(key)
        # Where nearly all segments are empty the common one may be, too.
        filled = np.bincount(row, minlength=len(sizes))
        for x in np.flatnonzero(use & (segments[np.maximum(cls, 0)] - filled >= (segments - differ)[np.maximum(cls, 0)])).tolist():
            held = set((cell[row == x] - base[x]).tolist())
            empty = np.array([k for k in range(int(segments[cls[x]])) if k not in held], dtype=np.uint64)
            with np.errstate(over="ignore"):
                rows.append(np.full(len(empty), x))
                out.append(mix64(mix64(empty * _ODD[3] + np.uint64(int(cls[x])) * _ODD[4]) + _ODD[0]))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(rows), np.concatenate(out)


def sketches(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SKETCH bytes per set: the low byte of the least hash in each of as many bins (255 for an empty bin)."""
    out = np.full(len(sizes) * SKETCH, 255, dtype=np.uint8)
    if len(values):
        with np.errstate(over="ignore"):
            v = mix64(values + _ODD[1])
        cell = np.repeat(np.arange(len(sizes)), sizes) * SKETCH + (v >> np.uint64(58)).astype(np.int64)
        order = np.lexsort((v, cell))
        cell, v = cell[order], v[order]
        first = np.r_[True, cell[1:] != cell[:-1]]
        out[cell[first]] = (v[first] & np.uint64(0xFF)).astype(np.uint8)
    return out.reshape(len(sizes), SKETCH)


# Prefix tree join of two blocks.

def trie_join(probes: list[np.ndarray], stored: list[np.ndarray], per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """All (probe, stored) positions with Jaccard similarity of at least ``per_cent`` %.

    The tree is held as the stored sets in lexicographic order with the length
    of the prefix each shares with the one before: a node is a shared prefix.
    """
    if not probes or not stored:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    words = np.unique(np.concatenate(stored))
    ids = [np.searchsorted(words, s) for s in stored]
    order = sorted(range(len(ids)), key=lambda i: ids[i].tolist())
    ids = [ids[i] for i in order]
    size = np.array([len(s) for s in ids])
    shared = np.zeros(len(ids) + 1, dtype=np.int64)
    for i in range(1, len(ids)):
        k = min(len(ids[i - 1]), len(ids[i]))
        differs = np.flatnonzero(ids[i - 1][:k] != ids[i][:k])
        shared[i] = differs[0] if len(differs) else k
    # Which probe holds which stored shingle, one column per probe.
    holds = np.zeros((len(words), len(probes)), dtype=np.uint8)
    for j, p in enumerate(probes):
        at = np.searchsorted(words, p)
        ok = (at < len(words)) & (words[np.minimum(at, len(words) - 1)] == p)
        holds[at[ok], j] = 1
    length = np.array([len(p) for p in probes], dtype=np.int64)
    everyone = np.arange(len(probes))
    need = lambda who, low: -(-per_cent * (length[who] + low) // (100 + per_cent))
    path: list[tuple[int, np.ndarray, np.ndarray]] = [(0, everyone, np.zeros(len(probes), dtype=np.int64))]
    out_a, out_b = [], []

    def walk(row: np.ndarray, depth: int, to: int, who: np.ndarray, overlap: np.ndarray, low: int, high: int):
        """Advance along one set, dropping probes that can't reach any set of the subtree (sizes low to high)."""
        while depth < to and len(who):
            step = min(to, depth + 24)
            overlap = overlap + holds[row[depth:step]][:, who].sum(axis=0, dtype=np.int64)
            depth = step
            can = overlap + np.minimum(high - depth, length[who] - overlap) >= need(who, low)
            if not can.all():
                who, overlap = who[can], overlap[can]
        return who, overlap

    for i, row in enumerate(ids):
        while path[-1][0] > shared[i]:
            path.pop()
        depth, who, overlap = path[-1]
        branch = int(shared[i + 1]) if i + 1 < len(ids) else 0
        if branch > depth:
            below = np.flatnonzero(shared[i + 1:len(ids)] < branch)
            end = i + 1 + (int(below[0]) if len(below) else len(ids) - i - 1)
            who, overlap = walk(row, depth, branch, who, overlap, int(size[i:end].min()), int(size[i:end].max()))
            path.append((branch, who, overlap))
            depth = branch
        n = len(row)
        fit = (100 * np.minimum(length[who], n) >= per_cent * np.maximum(length[who], n))
        who, overlap = walk(row, depth, n, who[fit], overlap[fit], n, n)
        linked = 100 * overlap >= per_cent * (length[who] + n - overlap)
        out_a.append(who[linked])
        out_b.append(np.full(int(linked.sum()), order[i]))
    return np.concatenate(out_a), np.concatenate(out_b)


# The distributed join.

def _prepare(docs: DataFrame, doc_id: str, text: str, words: int, per_cent: int) -> DataFrame:
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, "text", SLICE_BYTES):
            values, sizes = shingle_sets(bytes_of(part.column("text")), words)
            h1, h2 = set_hashes(values, sizes)
            rows, keys = signatures(values, sizes, per_cent)
            order = np.argsort(rows, kind="stable")
            offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(sizes)))].astype(np.int32)
            sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH), len(sizes), [None, pa.py_buffer(sketches(values, sizes).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(h1), pa.array(h2), sketch, pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[order].view(np.int64)))],
                                             names=["doc_id", "n_shingles", "h1", "h2", "sketch", "keys"])

    return src.mapInArrow(released(run), "doc_id long, n_shingles long, h1 long, h2 long, sketch binary, keys array<long>")


def _expand(base: DataFrame) -> DataFrame:
    """(key, node) rows; a task gives the keys of copies once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            fresh = []
            for x in nodes:
                fresh.append(x not in seen)
                seen.add(x)
            part = batch.filter(pa.array(fresh, pa.bool_()))
            lists = part.column("keys")
            counts = np.diff(lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(np.repeat(part.column("node").to_numpy(), counts))], names=["key", "node"])

    return base.select(F.xxhash64("h1", "h2").alias("node"), "keys").mapInArrow(released(run), "key long, node long")


def _meetings(keys: DataFrame, spark_partitions: int) -> DataFrame:
    """Distinct (key, node) rows of keys that at least two nodes share: rows are sorted and streamed."""
    ordered = keys.repartition(spark_partitions, "key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None  # the last row, if its key wasn't shared so far
        last_key, last_node, last_shared = None, None, False
        for batch in batches:
            k, v = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            if not len(k):
                continue
            new = np.r_[(k[0], v[0]) != (last_key, last_node), (k[1:] != k[:-1]) | (v[1:] != v[:-1])]
            k, v = k[new], v[new]
            if not len(k):
                continue
            last_node = v[-1]
            same = np.r_[last_key is not None and k[0] == last_key, k[1:] == k[:-1]]
            nxt = np.r_[same[1:], False]
            out_k, out_v = [k[same | nxt]], [v[same | nxt]]
            if pending is not None and same[0]:
                out_k.insert(0, np.array([pending[0]]))
                out_v.insert(0, np.array([pending[1]]))
            last_shared = bool(same[-1])
            last_key = k[-1]
            pending = None if last_shared else (k[-1], v[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_k)), pa.array(np.concatenate(out_v))], names=["key", "node"])

    return ordered.mapInArrow(released(run), "key long, node long")


def _ties(meetings: DataFrame, sketch: DataFrame, agree: int) -> DataFrame:
    """Links (u, v) between nodes of one meeting whose sketches agree in ``agree`` bytes.

    Meetings above MEETING nodes are dealt to chunks and every pair of chunks meets.
    """
    big = meetings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MEETING).select("key", F.ceil(F.col("n") / MEETING).cast("long").alias("c"))
    m = meetings.join(big, "key", "left").withColumn("c", F.coalesce("c", F.lit(1).cast("long"))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("c")))
    # Part p takes part in the meetings (i, j), i <= j, of the parts i = p or j = p.
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1), lambda q: F.least(q, F.col("part")) * F.col("c") + F.greatest(q, F.col("part"))))
    dealt = m.select("key", "node", pair.alias("pair")).join(sketch, "node").repartition(partitions(meetings.sparkSession), "key", "pair").sortWithinPartitions("key", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def close():
            node = np.array([x[0] for x in held], dtype=np.int64)
            s = np.frombuffer(b"".join(x[1] for x in held), dtype=np.uint8).reshape(-1, SKETCH)
            node, first = np.unique(node, return_index=True)
            s = s[first]
            a, b = [], []
            for i in range(len(node) - 1):
                close_to = np.flatnonzero((s[i + 1:] == s[i]).sum(axis=1) >= agree) + i + 1
                if len(close_to):
                    a.append(np.full(len(close_to), node[i]))
                    b.append(node[close_to])
            if not a:
                return None
            members, roots = union_roots(np.concatenate(a), np.concatenate(b))
            move = members != roots
            return members[move], roots[move]

        for batch in batches:
            found = []
            for key, pair, node, sketch_bytes in zip(*(batch.column(c).to_pylist() for c in ("key", "pair", "node", "sketch")), strict=True):
                if (key, pair) != current:
                    if len(held) > 1 and (got := close()) is not None:
                        found.append(got)
                    held, current = [], (key, pair)
                held.append((node, sketch_bytes))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([y for _, y in found]))], names=["u", "v"])
        if len(held) > 1 and (got := close()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["u", "v"])

    return dealt.select("key", "pair", "node", "sketch").mapInArrow(released(run), "u long, v long").distinct()


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, per_cent: int = 80, agree: int = AGREE) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row.

    Two documents link when ``100 * |intersection| >= per_cent * |union|`` of
    their sets of distinct ``words``-word shingles (a shorter text is one
    shingle of all its words). ``component_id`` is the smallest doc_id
    reachable; ``n_links`` counts the other documents linked directly. Null,
    empty and blank texts have no shingles and link with nothing. Repeated ids
    are separate rows that share an id; rows with a null id have their shingle
    count, no links and a null component. Other columns are ignored. An empty
    table gives no rows. Whole texts count; 64-bit hashes stand for shingles.
    ``agree`` is the gate of step 2 above; 0 makes the result exact.
    """
    if not 0 <= agree <= SKETCH:
        raise ValueError(f"agree must lie between 0 and {SKETCH}")
    spark = docs.sparkSession
    small_batches(spark)
    base = cut(_prepare(docs, doc_id, text, words, per_cent), "shingles")
    real = base.filter(F.col("n_shingles").cast("boolean") & F.col("doc_id").isNotNull())
    classes = cut(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
    # One row stands for a class, also where rows repeat an id.
    node_rows = real.join(classes, (real["h1"] == classes["h1"]) & (real["h2"] == classes["h2"]) & (real["doc_id"] == classes["node"])).select(
        real["h1"], real["h2"], "node", "copies", "n_shingles", "sketch").dropDuplicates(["h1", "h2"])
    nodes = cut(node_rows.withColumn("node", F.xxhash64("h1", "h2")), "nodes")
    meetings = cut(_meetings(_expand(real), partitions(spark)), "meetings")
    ties = _ties(meetings, nodes.select("node", "sketch"), agree)
    clusters = cut(components(ties), "clusters")
    counts, links = _join_clusters(docs, doc_id, text, words, per_cent, clusters, nodes, classes)
    found = components(links)
    named = classes.select("h1", "h2", F.xxhash64("h1", "h2").alias("node"), F.col("node").alias("least"), "copies")
    whole = named.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = cut(whole.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    per_class = whole.join(least, "component").join(counts, "node", "left").select(
        "h1", "h2", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = base.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("h1")).alias("h1"), "h2").join(cut(per_class, "classes"), ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))


FILTER_BITS = 1 << 25


def _bit_positions(ids: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix64(ids.astype(np.uint64) * _ODD[0])
    return [(h >> np.uint64(s)) % np.uint64(FILTER_BITS) for s in (0, 32)]


def _bit_filter(ids: DataFrame) -> np.ndarray:
    """Bloom filter of FILTER_BITS bits (4 MB at any size of the input) over a column ``id``.

    It only spares work: what passes is joined exactly. With far more ids than
    bits everything passes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(FILTER_BITS, dtype=bool)
        for batch in batches:
            for at in _bit_positions(batch.column("id").to_numpy()):
                own[at.astype(np.int64)] = True
        packed = np.packbits(own, bitorder="little").view("<i8")
        used = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(packed[used])], names=["word", "bits"])

    merged = ids.mapInArrow(released(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype="<i8")
    out[merged.column("word").to_numpy()] = merged.column("bits").to_numpy()
    return out.view(np.uint8)


def _may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 for at in _bit_positions(ids)]).astype(bool)


def _join_clusters(docs, doc_id, text, words, per_cent, clusters, nodes, classes):
    """(counts: node, linked) and links (u, v) inside clusters, by prefix tree joins of block pairs."""
    spark = docs.sparkSession
    member = clusters.join(nodes.select("node", "h1", "h2", "n_shingles", "copies"), "node")
    load = member.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("c"))
    load = cut(load, "load")
    placed = member.join(load, "component").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("c")))
    placed = placed.join(classes.select("h1", "h2", F.col("node").alias("least")), ["h1", "h2"]).select("least", "node", "h1", "h2", "copies", "component", "c", "part")
    placed = cut(placed, "placed")
    bits = spark.sparkContext.broadcast(_bit_filter(placed.select(F.col("least").alias("id"))))
    one = docs.select(F.col(doc_id).cast("long").alias("least"), F.col(text).alias("text")).filter(F.col(doc_id).isNotNull())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (b.filter(pa.array(_may_hold(bits.value, b.column("least").to_numpy()))) for b in batches if b.num_rows)
        for part in row_slices(wanted, "text", SLICE_BYTES):
            values, sizes = shingle_sets(bytes_of(part.column("text")), words)
            raw, first = values.tobytes(), np.r_[0, np.cumsum(sizes)] * 8
            h1, h2 = set_hashes(values, sizes)
            yield pa.RecordBatch.from_arrays([part.column("least"), pa.array(h1), pa.array(h2), pa.array([raw[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())],
                                             names=["least", "h1", "h2", "values"])

    # The hashes are compared, too: another row may share the id but not the text.
    # The placed rows grow with the data, so they are never broadcast.
    held = one.mapInArrow(released(sets), "least long, h1 long, h2 long, values binary").join(placed.hint("merge"), ["least", "h1", "h2"])
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1), lambda q: F.least(q, F.col("part")) * F.col("c") + F.greatest(q, F.col("part"))))
    dealt = held.select("component", pair.alias("pair"), "c", "part", "node", "copies", "values").repartition(partitions(spark), "component", "pair").sortWithinPartitions("component", "pair", "part", "node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        current = None

        def close():
            seen, left, right = set(), [], []
            i, j = divmod(current[1], rows[0][0])
            for _, part, node, copies, values in rows:
                if node not in seen:  # rows that repeat an id and a text
                    seen.add(node)
                    (left if part == i else right).append((node, copies, np.frombuffer(values, dtype=np.uint64)))
            if i == j:
                right = left
            a, b = trie_join([x[2] for x in left], [x[2] for x in right], per_cent)
            na, nb = np.array([x[0] for x in left], dtype=np.int64)[a], np.array([x[0] for x in right], dtype=np.int64)[b]
            other = na != nb
            a, b, na, nb = a[other], b[other], na[other], nb[other]
            if not len(a):
                return None
            # Counts of linked documents per node; inside one block every pair occurs in both directions.
            wb = np.array([x[1] for x in right], dtype=np.int64)[b]
            nodes_of, weight = (na, wb) if i == j else (np.concatenate([na, nb]), np.concatenate([wb, np.array([x[1] for x in left], dtype=np.int64)[a]]))
            who, at = np.unique(nodes_of, return_inverse=True)
            linked = np.bincount(at, weights=weight).astype(np.int64)
            members, roots = union_roots(na, nb)
            root = dict(zip(members.tolist(), roots.tolist(), strict=True))
            return who, linked, np.array([root[x] for x in who.tolist()], dtype=np.int64)

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in range(3)], names=["node", "linked", "root"])

        for batch in batches:
            found = []
            for component, pair, c, part, node, copies, values in zip(*(batch.column(x).to_pylist() for x in ("component", "pair", "c", "part", "node", "copies", "values")), strict=True):
                if (component, pair) != current:
                    if rows and (got := close()) is not None:
                        found.append(got)
                    rows, current = [], (component, pair)
                rows.append((c, part, node, copies, values))
            if found:
                yield batch_of(found)
        if rows and (got := close()) is not None:
            yield batch_of([got])

    result = cut(dealt.mapInArrow(released(join), "node long, linked long, root long"), "joined")
    return result.groupBy("node").agg(F.sum("linked").alias("linked")), result.select(F.col("node").alias("u"), F.col("root").alias("v"))
