"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pandekt.llm import ann, chat, line_dedup, mixing, near_vectors, ngram_join, packing, token_store, toxicity, warc
from pandekt.llm.components import components
from pandekt.llm.tokens import PieceEncoder, default_path
from tests.llm import brute

#: Names that operators use inside; none may disturb them.
CLASH = ("_n", "_r", "_d", "_t", "_id", "_drop", "node", "key", "keys", "h1", "h2", "part", "pair", "c", "component", "component_id", "vec", "label2",
         "tokens", "epoch", "block", "start", "score", "ids", "nth", "shard", "bucket", "n_lines", "n_dropped", "sketch", "least", "copies", "payload", "sha", "rank", "t", "turns")


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijÄéñ") for _ in range(rng.randint(1, 9)))
    line = "A line that many Documents share, word for word"
    out = [None, "", "\n", " \t ", "x", "one two", "é" * 25, line, f" {line.lower()}\t\n{line}", f"{line}\n" * 3, "word " * 60_000]
    base = [word() for _ in range(200)]
    for k in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w) + ("\n" + line if k % 3 else "\r\n" + word()))
    for _ in range(40):
        out.append("\n".join(" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))))
    return out + out[11:20]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 - i, t, "en", f"s{i % 4}" if i % 9 else None, None) for i, t in enumerate(texts())]
    return rows, clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and repeated ids, alike and different."""
    t = "the same seven words make one line"
    rows = [(None, t, "en", "a", 1), (None, t, "en", "a", 1), (1, t, None, "a", None), (1, t, None, "a", None), (1, "another text with the same id here", None, "b", None), (2, f"{t}\n{t}", None, None, None), (3, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def plain_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    where = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                where.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(where.get(key(x), ())) >= min_docs and max(where[key(x)]) != i)]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_line_dedup(docs, batches):
    rows, df = docs
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df, batches=batches).collect()}
    assert got == plain_lines([(r[0], r[1]) for r in rows])


def test_line_runs_grow(spark, docs):
    rows, df = docs
    runs = line_dedup.LineRuns(spark)
    # Small ids first: a later batch has the larger keeper.
    for part in (F.col("doc_id") < 40, (F.col("doc_id") >= 40) & (F.col("doc_id") < 70), F.col("doc_id") >= 70):
        runs.add(line_dedup.line_hashes(df.filter(part), "doc_id", "text", 20))
    got = {(r.n_docs, r.keeper) for r in runs.compact().filter("n_docs >= 3").collect()}
    shared = max((t for t in texts() if t), key=lambda t: t.count("many Documents"))
    assert shared and any(n > 20 for n, _ in got)
    for name in runs.runs():
        spark.sql(f"DROP TABLE {name}")


def test_line_dedup_odd(odd, empty):
    got = sorted(map(tuple, line_dedup.dedup_lines(odd).select("doc_id", "n_lines", "n_dropped").collect()), key=repr)
    # The line is in the documents null, 1 and 2: the last keeps it.
    assert got == sorted([(None, 1, 1), (None, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 0), (2, 2, 0), (3, 1, 0)], key=repr)
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("words,per_cent", [(4, 85), (5, 80)])
def test_ngram_join(docs, words, per_cent):
    rows, df = docs
    for agree in (ngram_join.AGREE, 0):
        joined = ngram_join.ngram_join(df, words=words, per_cent=per_cent, agree=agree)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in joined.collect()}
        assert got == brute.ngram_components([(r[0], r[1]) for r in rows], words, per_cent)


def test_ngram_join_odd(odd, empty):
    got = sorted(map(tuple, ngram_join.ngram_join(odd).collect()), key=repr)
    assert sorted(got, key=repr) == sorted([(None, 3, None, 0), (None, 3, None, 0), (1, 3, 1, 1), (1, 3, 1, 1), (1, 3, 1, 0), (2, 7, 2, 0), (3, 0, 3, 0)], key=repr)
    assert ngram_join.ngram_join(empty).count() == 0


def test_components_of_chains_stars_and_hubs(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(300, 420)] + [(0, i) for i in range(1, 200)] + [(1000 + rng.randrange(150), 1000 + rng.randrange(150)) for _ in range(120)] + [(7, 7), (5, 3)]
    df = spark.createDataFrame(links, "u long, v long").repartition(6)
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    root = brute.roots(len(nodes), [(at[a], at[b]) for a, b in links if a != b])
    want = sorted((x, nodes[root[i]]) for i, x in enumerate(nodes))
    assert sorted(map(tuple, components(df).collect())) == want
    assert sorted(map(tuple, components(df, small=0).collect())) == want
    assert components(df.limit(0)).count() == 0 and components(df.limit(0), small=-1).count() == 0


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = []
    for _ in range(120):
        s = set(rng.choice(pool, rng.integers(1, 60)).tolist())
        sets.append(s)
        if rng.random() < 0.6:
            sets.append(set(list(s)[: max(1, int(len(s) * 0.9))]))
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    for per_cent in (50, 80, 85, 100):
        a, b = ngram_join.trie_join(arrays[:90], arrays[60:], per_cent)
        want = {(i, j) for i in range(90) for j in range(len(arrays) - 60) if 100 * len(sets[i] & sets[60 + j]) >= per_cent * len(sets[i] | sets[60 + j])}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(3)
    for per_cent in (80, 85):
        for n in [*range(5, 60), 119, 480, 1700]:
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = int(len(x) * (100 - per_cent) / 100)
            y = x[drop:]
            half = ngram_join.largest_difference(2 * len(x), per_cent) // 2
            z = np.unique(np.r_[x[half:], rng.integers(0, 2**63, half).astype(np.uint64)])
            for other in (y, z):
                if 100 * len(np.intersect1d(x, other)) >= per_cent * len(np.union1d(x, other)):
                    _, a = ngram_join.signatures(x, np.array([len(x)]), per_cent)
                    _, b = ngram_join.signatures(other, np.array([len(other)]), per_cent)
                    assert len(x) == len(np.intersect1d(x, other)) == len(other) or len(np.intersect1d(a, b))


def test_pieces_encode_like_whole_texts():
    encoder, whole = PieceEncoder(default_path(), max_entries=50), Tokenizer.from_file(default_path())
    hard = ["a  b\n\nc   d \n e", " a", "\n", "", "  ", "a ", "é  b\x1c c", "x\t y\n\n\nz", "don't 's <|endoftext|> ok<|endoftext|>", " '", "\n\nA", "a \0x", "\0", "a\t \tb", "é. b, 1. 2, ..", "a  b c"]
    hard += [t for t in texts() if t] + ["w\n x " * 400_000]
    # Letters, marks, contractions, blanks and added tokens next to each other in any order.
    bits = ["the", "don't", "'s", "é", "Ünï", "ª", "×", "÷", "1", "2a", "...", "&&&", "<|endoftext|>", "<|", " ", "\n", "  ", "\n\n", "\t", "\0", "\x1c", "\x85", "漢字", "ǅ", "ɐ", "🙂",
            "a.b", "x,", "'re", "we're!", "_", "ſ", "İ", ".'s", "A" * 70, "\u0301", "e\u0301"]
    draw = random.Random(3)
    hard += ["".join(draw.choice(bits) + draw.choice(["", " ", "", "\n", " "]) for _ in range(draw.randint(1, 9))) for _ in range(4000)]
    got = encoder.encode_many(hard)
    for t, g in zip(hard, got, strict=True):
        assert np.frombuffer(g, dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_token_store(spark, docs, odd, empty):
    rows, df = docs
    whole = Tokenizer.from_file(default_path())
    want, before = {}, 0
    for i, t in sorted((r[0], r[1]) for r in rows):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[i] = (before, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        before += len(ids)
    store = token_store.write_store(df, default_path(), shards=3, bucket_keys=20)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in store.get(token_store.document_keys(df)).collect()}
    assert got == want
    unknown = spark.createDataFrame([(10**9 + k, 0) for k in range(300)], "doc_id long, nth long")
    assert store.get(unknown).count() == 0
    store = token_store.write_store(odd, default_path())
    keys = token_store.document_keys(odd)
    assert sorted(map(tuple, keys.collect()), key=repr) == sorted([(None, 0), (None, 1), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0)], key=repr)
    assert store.get(keys).count() == 7
    assert token_store.write_store(empty, default_path()).get(keys).count() == 0


def test_minimal_perfect_hash():
    keys = [f"k{i}" for i in range(5000)]
    h1, h2 = token_store.digests(keys)
    sizes, bits, slot = token_store.build_hash(h1, h2)
    assert sorted(slot.tolist()) == list(range(5000))
    assert (token_store.find_slots(sizes, bits, h1, h2) == slot).all()
    with pytest.raises(ValueError):
        token_store.build_hash(h1[[0, 0]], h2[[0, 0]])


def test_packing(docs, odd, empty):
    rows, df = docs
    whole = Tokenizer.from_file(default_path())
    ids = {r[0]: np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in rows}
    got = packing.pack_documents(df, default_path(), capacity=256, max_span=64, block_windows=16).toPandas()
    for i, part in got.sort_values("start").groupby("doc_id"):
        assert b"".join(part.ids) == ids[i].tobytes() and (part.doc_tokens == len(ids[i])).all()
        assert (part.start == part.length.cumsum() - part.length).all()
    assert all(zlib.crc32(x) == c for x, c in zip(got.ids, got.ids_crc32, strict=True))
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert (part.offset == part.length.cumsum() - part.length).all() and part.length.sum() <= 256
    assert got.length.sum() >= 0.9 * 256 * got.sequence_id.nunique()
    assert packing.pack_documents(odd, default_path()).groupBy().sum("length").first()[0] == sum(packing.pack_documents(odd, default_path()).toPandas().length)
    assert packing.pack_documents(odd, default_path()).filter("doc_id = 3").first().doc_tokens == 1
    assert packing.pack_documents(empty, default_path()).count() == 0


def test_differencing_deals_everything():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        sizes = rng.integers(1, 400, n)
        window = packing.deal(sizes, 512)
        assert np.bincount(window, weights=sizes).max() <= 512 and len(window) == n


def test_mixing(spark, docs, odd, empty):
    rows, df = docs
    uses = mixing.mix(df, block_tokens=64).toPandas()
    tokens = {r[0]: len(re.findall(brute.SPACE, r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    total = {}
    for i, t in tokens.items():
        total[source[i]] = total.get(source[i], 0) + t
    assert set(uses.doc_id) == set(tokens)
    assert (uses.groupby("doc_id").size() <= 2).all()
    for (s, e), part in uses.groupby(["source", "epoch"], dropna=False):
        part = part.sort_values(["start", "tokens"])
        assert (part.start == part.tokens.cumsum() - part.tokens).all() or e > 0
        assert e > 0 or part.tokens.sum() == total[s if isinstance(s, str) else None]
    assert mixing.mix(odd).select("source", "doc_id").distinct().count() == 5
    assert mixing.mixed_documents(odd).count() >= 7
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(df, repeat_limit=None, entropy=0.5).count() > 0


def test_mix_deals_wordless_rows_to_blocks(spark):
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("blank").alias("source"), F.lit(" ").alias("text"))
    blocks = mixing.mix(rows.unionByName(spark.createDataFrame([(-1, "b", "some words")], "doc_id long, source string, text string"))).groupBy("source", "block").count().collect()
    blank = [r["count"] for r in blocks if r.source == "blank"]
    assert sum(blank) == 100_000 and len(blank) == 2 and max(blank) < 60_000


def test_temperature_targets(spark):
    src = spark.createDataFrame([("a", 8000), ("b", 1000), ("c", 1000), ("d", 500), ("e", 0)], "source string, tokens long")
    p = np.array([8000, 1000, 1000, 500]) / 10500
    alpha = mixing.temperature(src, repeat_limit=4.0).first().alpha
    assert abs((8000 / 500) ** (1 - alpha) - 4) < 1e-9
    alpha = mixing.temperature(src, repeat_limit=None, entropy=1.2).first().alpha
    w = p ** alpha / (p ** alpha).sum()
    assert abs(-(w * np.log(w)).sum() - 1.2) < 1e-9
    assert mixing.temperature(src, repeat_limit=100.0).first().alpha == 0
    assert mixing.temperature(src, repeat_limit=None, entropy=9.0).first().alpha < 1e-9


def pages():
    big = "<p>" + "ü" * 300_000
    return [(5, "http://a", "<html>x"), (3, "http://b c\r\nd", "<html>x"), (9, None, None), (8, "http://e", ""), (1, "http://f", big), (2, "http://g", "WARC/1.1\r\n\r\n\r\n\r\n"), (7, "", "<html>x"), (4, "http://h", big)]


def test_warc_round_trip(spark, tmp_path):
    rows = pages()
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in warc.round_trip(df, folder=f"file://{tmp_path}/w").collect()}
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in rows:
        payload = (h or "").encode()
        r, own = got[i], first[h or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == own else ("revisit", own))
        assert (bytes(r.payload) == payload) if i == own else r.payload is None
    assert warc.round_trip(df.limit(0), folder=f"file://{tmp_path}/e").count() == 0


def test_warc_members_stand_alone(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    df = spark.createDataFrame([(None, None, "same"), (None, "u", "same"), (4, "u", "same"), (4, "u", "same"), (6, "v", "other")], "page_id long, url string, html string")
    index = warc.normalise(warc.write_archives(df, folder), folder)
    rows = index.collect()
    for r in rows:
        with open(warc.member_uri(folder, r.archive).removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            member = zlib.decompressobj(31)
            assert member.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n") and member.eof
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_records(index, folder).collect() if r.page_id)
    assert got == [(4, "response", None), (4, "revisit", 4), (6, "response", None)]


def test_inflate_reads_members_and_one_stream():
    import io
    parts = [b"x" * 5_000_000, b"", b"tail"]
    stream = b"".join(zlib.compress(p, 1, 31) for p in parts)
    assert b"".join(warc.inflate(io.BytesIO(stream), 1000)) == b"".join(parts)


CHATS = [(1, 1, "user", "hi"), (1, 2, "assistant", " hello\n"), (1, 3, "assistant", "\\[INST] <|text|> \\\\ [\\INST]"), (2, 0, "user", None), (2, None, "system", "s"), (2, 1, "assistant", None),
         (3, 1, "assistant", "ties"), (3, 1, "assistant", "ties"), (3, 1, "assistant", "a"), (4, 1, None, "x"), (None, 1, "assistant", "é🙂 <|end|>"), (5, 1, "assistant<|text|>", "role"), (6, 1, "assistant", "</s>[INST] " * 2000)]


def test_chat(spark):
    df = clashing(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").repartition(3))
    out = chat.format_conversations(df, default_path())
    got = {r.conv_id: r for r in chat.read_back(out, default_path()).collect()}
    by = {}
    for c, t, r, x in CHATS:
        by.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0), default_path()).count() == 0


def test_escape_is_reversible():
    rng = random.Random(1)
    alphabet = ["\\", "<", "|", "s", ">", "/", "[INST]", "[/INST]", "</s>", "<|end|>", "<|tu", "rn|>", "a", "\n", "<<SYS>>"]
    for _ in range(2000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def vectors():
    rng = np.random.default_rng(4)
    out, centre = [], rng.standard_normal((3, 16))
    for k in range(60):
        out.append((k, (centre[k % 3] + rng.standard_normal(16) * (0.03 if k < 40 else 0.5)).tolist(), k % 2))
    out += [(60, out[0][1], 0), (61, out[0][1], 1), (62, out[0][1], None), (63, None, 0), (64, [0.0] * 16, 0), (65, [float("nan")] * 16, 0), (66, [None] * 16, 1), (67, [float("inf")] + [1.0] * 15, 1),
            (68, [1e200 * x for x in out[2][1]], 0), (69, [-0.0] * 15 + [1.0], 1), (70, [0.0] * 15 + [1.0], 1), (100, out[4][1], 1), (150, out[5][1], 1)]
    return out


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_near_vectors(spark):
    rows = vectors()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").drop("vec"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()}
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if good(rows[i][1]) and good(rows[j][1]) and rows[i][2] is not None and rows[i][2] == rows[j][2] and cosine(rows[i][1], rows[j][1]) >= 0.98]
    root, degree = brute.roots(len(rows), pairs), np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    assert got == {r[0]: (degree[i], rows[root[i]][0], root[i] == i) for i, r in enumerate(rows)}
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def beside(rng, centre, cos, spread, n):
    """n distinct vectors around one at that cosine to ``centre``."""
    side = rng.standard_normal(len(centre))
    side -= side @ centre * centre
    middle = cos * centre + np.sqrt(1 - cos * cos) * side / np.linalg.norm(side)
    return [(middle + spread * rng.standard_normal(len(centre))).tolist() for _ in range(n)]


def test_near_vectors_saturated(spark):
    """Groups larger than a list, linked with each other: every list fills up inside its own group."""
    rng = np.random.default_rng(9)
    centre = np.eye(16)[0]
    vecs = [v for _ in range(4) for v in beside(rng, centre, 0.9935, 0.002, 12)] + [v for cos in (1.0, 0.984) for v in beside(rng, np.eye(16)[1], cos, 0.001, 30)]
    cos = [[cosine(a, b) for b in vecs] for a in vecs]
    assert min(cos[i][j] for i in range(48, 78) for j in range(48, 78)) > 0.999 and min(cos[i][j] for i in range(48, 78) for j in range(78, 108)) > 0.98
    pairs = [(i, j) for i in range(len(vecs)) for j in range(i) if cos[i][j] >= 0.98]
    root, degree = brute.roots(len(vecs), pairs), np.bincount(np.array(pairs).ravel(), minlength=len(vecs))
    df = spark.createDataFrame([(i, v, 3) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(df).collect()}
    assert got == {i: (degree[i], root[i]) for i in range(len(vecs))}


def test_near_vectors_audit(spark):
    """A large group that is complete doesn't outweigh lost pairs, a recall out of reach isn't passed over, deeper trees are more."""
    rng = np.random.default_rng(2)
    hot = [(i, v, 1) for i, v in enumerate(beside(rng, np.eye(64)[0], 1.0, 0.001, 150))]
    pairs = [(150 + 2 * i + j, v, 1) for i in range(30) for j, v in enumerate(beside(rng, np.eye(64)[1 + i], 1.0, 0.001, 2))]
    nodes = spark.createDataFrame([(i, v, lab, 1) for i, v, lab in hot + pairs], "node long, vec array<double>, label long, copies long")
    counted = lambda rest: spark.createDataFrame([(i, 0, 149) for i in range(150)] + rest, "node long, component long, linked long")
    lost = near_vectors.audit(nodes, counted([]), 0.98)
    assert {(b, share) for b, _, share in lost} == {(1, 0.0), (128, 1.0)}
    half = near_vectors.audit(nodes, counted([(i, i - i % 2, 1) for i in range(150, 180)]), 0.98)
    assert {(b, share) for b, _, share in half} == {(1, 0.5), (128, 1.0)}
    df = spark.createDataFrame(hot + pairs, "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="recall"):
        near_vectors.near_vectors(df, recall=1.01, max_forests=1, rounds=1)
    assert near_vectors._trees(0, 0.98) == near_vectors._trees(5, 0.98) == 8
    for depth in (14, 20):
        assert (1 - 0.93623 ** depth) ** near_vectors._trees(depth, 0.98) <= 0.00101


def test_nearest(spark):
    rows = vectors()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = {}
    for r in ann.nearest(df, shards=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    pool = [(r[0], r[1]) for r in rows if good(r[1])]
    for q in (i for i, _ in pool if i % 50 == 0):
        own = dict(pool)[q]
        best = sorted(((-round(cosine(own, v), 12), i) for i, v in pool if i != q))[:5]
        assert [x[1] for x in sorted(got[q])] == [i for _, i in best]
        assert np.allclose([x[2] for x in sorted(got[q])], [-s for s, _ in best])
    assert ann.nearest(df.limit(0)).count() == 0
    two = ann.nearest(df.filter("vec_id IN (0, 1)")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(0, 1, 1)]


def test_vectors_of_different_length_raise(spark):
    """Also where the lengths of a batch would divide evenly."""
    for vecs in ([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0, 8.0]], [[1.0, 2.0]] * 3 + [[1.0, 2.0, 3.0]]):
        df = spark.createDataFrame([(50 * i, v, 1) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int")
        for run in (ann.nearest, near_vectors.near_vectors):
            with pytest.raises(ValueError, match="components"):
                run(df)
        with pytest.raises(ValueError, match="components"):
            near_vectors.matrix(pa.array(vecs))


def test_nearest_with_repeated_ids(spark):
    """Ten rows of the query's own id stand nearer than anything else; a row that repeats id and vector is one."""
    rng = np.random.default_rng(3)
    near = [(0, [1.0, 0.0, k / 1e4]) for k in range(10)]
    others = [(i, rng.standard_normal(3).tolist()) for i in range(1, 30)]
    rows = near + others + [others[4], (7, [1.0, 0.5, 0.0])]
    got = [(r["rank"], r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("query_id = 0").orderBy("rank").collect()]
    best = sorted({(-cosine(near[0][1], v), i) for i, v in rows if i})[:5]
    assert got == [(k + 1, i) for k, (_, i) in enumerate(best)]


def test_graph_recall():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, entry = ann.build_graph(x)
    found, _, _ = ann.beam_search(x, graph, entry, x[:100], 64)
    true = np.argsort(-(x[:100] @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(found.tolist(), true.tolist(), strict=True)]) >= 0.9


def test_toxicity(spark, empty):
    rng = random.Random(8)
    filler = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(filler) for _ in range(rng.randint(5, 300))]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["badword", "grimterm", f"slurry{rng.randint(0, 99)}"])
        rows.append((i, " ".join(words)))
        if i < 700:
            labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "w1 w2"), (5002, "w3 " * 50_000)]
    labels += [(None, 1), (2, None), (0, 1)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), per_class=200)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert len(got) == len(rows)
    fresh = [(got[i] >= 0.7) == (i % 4 == 0) for i in range(700, 900)]
    assert np.mean(fresh) >= 0.95
    assert all(got[i] < 0.7 for i in (5000, 5001, None, 5002))
    assert toxicity.score(empty, model).count() == 0
    untaught = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(df, untaught).filter("score >= 0.7").count() == 0


def test_network_gradient():
    rng = np.random.default_rng(0)
    words = toxicity.Words([b"one two three badly four", b"two five, two"])
    m = {k: v.astype(np.float64) for k, v in toxicity.new_model().items()}
    m["word"] += rng.standard_normal(m["word"].shape) * 0.3
    m["char"] += rng.standard_normal(m["char"].shape) * 0.3
    position, mask, _ = toxicity.windows(words.counts)
    weight = np.array([0.7, -1.3])
    logit, cache = toxicity.forward(m, words, position, mask, keep=True)
    grads = toxicity.backward(m, words, cache, weight)
    for k in ("Uf", "Ub", "Wf", "Wb", "cf", "A", "q", "o"):
        at = tuple(int(rng.integers(s)) for s in m[k].shape)
        old, eps = m[k][at], 1e-2
        m[k][at] = old + eps
        up = toxicity.forward(m, words, position, mask)[0] @ weight
        m[k][at] = old - eps
        down = toxicity.forward(m, words, position, mask)[0] @ weight
        m[k][at] = old
        assert abs((up - down) / (2 * eps) - grads[k][at]) < 2e-3
