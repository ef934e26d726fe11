"""Ranked search over treaps against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pandekt.llm import treap
from tests.llm import brute

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text); unique ids."""
    terms = lambda t: TERM.findall((t or "").translate(brute.LOWER))
    tf = {i: Counter(terms(t)) for i, t in docs if i is not None}
    tf = {i: c for i, c in tf.items() if c}
    n_docs, n_all = len(tf), sum(map(Counter.total, tf.values()))
    df = Counter(t for c in tf.values() for t in c)
    out = []
    for item, text in items:
        if item is None:
            continue
        scores = []
        for i, c in tf.items():
            m = 100 - 90 + 90 * c.total() * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(7)
    words = ["l2", "Été", "7", "a", *(f"t{i}" for i in range(150))]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(1000 - i, text(rng.randint(0, 70))) for i in range(300)] + [(i, "the same text") for i in range(20)]
    docs += [(2000, None), (2001, ""), (2002, "--- \t"), (2003, "t3 l2," * 250_000), (2004, "unique-token")]
    items = [(i, text(rng.randint(0, 30))) for i in range(20)] + [(50, None), (51, ""), (52, "absent words only"), (53, "Same TEXT"), (54, "t3 t3 t3"), (None, "t3"), (55, "unique token " + text(3000))]
    return docs, items


@pytest.mark.parametrize("shard_words,k,beam,open_cells", [(treap.SHARD_WORDS, 10, 64, 1 << 21), (200, 10, 2, 64), (1, 3, 1, 1), (3000, 400, 8, 4000)])
def test_against_scoring_everything(spark, tables, shard_words, k, beam, open_cells, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(treap, "OPEN_CELLS", open_cells)
    monkeypatch.setattr(treap.Treap.search, "__defaults__", (beam,))
    rows = [(*d, "x", 1) for d in [*docs, (None, "t3 t4 t5")]]
    df = spark.createDataFrame(rows if shard_words > 1 else rows[:60], "doc_id long, text string, term string, score int").repartition(3)
    index = treap.build_index(df, shard_words=shard_words)
    got = treap.search(index, spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, uri string"), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(docs if shard_words > 1 else docs[:60], items, k)


def test_empty_tables(spark, tables):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    index = treap.build_index(none)
    assert (index.n_docs, index.n_terms) == (0, 0)
    assert treap.search(index, no_items).count() == 0
    some = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a")], "doc_id long, text string")
    assert treap.search(index, some.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert treap.search(treap.build_index(some), no_items).count() == 0
    repeated = treap.search(treap.build_index(some), spark.createDataFrame([(1, "b"), (1, "b")], "item_id long, text string"))
    assert [(r["rank"], r.doc_id) for r in repeated.orderBy("rank").collect()] == [(1, 1), (2, 1)]


def test_file_keeps_the_shard(tmp_path):
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 40, size=n) for n in (5, 17, 1, 60)]
    shard = treap.Shard.build({b"%d" % i: i for i in range(40)}, words, [9, 3, 7, 1], 4, 83)
    path = tmp_path / "one.k2t"
    path.write_bytes(shard.dump())
    back = treap.Shard.load(f"file://{path}")
    assert back.terms == shard.terms and back.ids.tolist() == [1, 3, 7, 9]
    assert treap.Shard.frequencies(f"file://{path}")[1].tolist() == shard.dfs.tolist()
    for level in range(shard.treap.height + 1):
        assert (back.treap._top[level] == shard.treap._top[level]).all()
