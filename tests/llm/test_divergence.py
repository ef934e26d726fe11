"""Source divergence: hash-consed trees and whole results against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pandekt.llm import divergence
from tests.llm import brute

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, top):
    """rows: (lang, source, text)."""
    groups, docs, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(brute.LOWER))
        groups[lang, source].update(words)
        total[lang].update(words)
        docs[lang].update(set(words))
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = lambda c: sum(c[t] for t in kept) + 5 * len(kept)
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // whole(c)
        pairs = [(-sum(abs(p(own, t) - p(c, t)) for t in kept), s) for (la, s), c in groups.items() if la == lang and s != source]
        terms = [(p(total[lang], t) - p(own, t), t) for t in kept if own[t] and p(own, t) > p(total[lang], t)]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:limit], 1):
                out.append((lang, source, part, item, -value, rank))
    return sorted(out)


def texts():
    rng = random.Random(11)
    words = ["été", "Zug", "zug", "a", "bb", "naïve", "x1y", "日本", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "S1"]), " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", "s1", None), ("en", "empty", ""), ("en", "empty", "12 34 --"), ("xx", "alone", "nothing kept here"), ("xx", "other", ""), ("yy", "single", "one"), ("en", "long", "zug bb, " * 300_000)]
    return rows + rows[:5]


@pytest.mark.parametrize("min_docs,top", [(30, 50), (3, 4), (1000, 50)])
def test_against_plain_counting(spark, min_docs, top):
    rows = texts()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "lang string, source string, text string, term string, n string").repartition(4)
    got = divergence.source_divergence(df, min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, min_docs, top)


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_small_worker_memory_gives_the_same(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    monkeypatch.setattr(divergence, "HELD", 20)
    assert sorted(map(tuple, divergence.source_divergence(df, min_docs=3, top=9).collect())) == plain(rows, 3, 9)


def test_blocks_of_terms_and_groups_add_up(spark):
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.7, size=(7, 45))
    whole = counts.sum(axis=1) + 5 * 45
    cells = [("en", g + 1, t + 1, int(counts[g, t])) for g in range(7) for t in range(45) if counts[g, t]]
    cells = spark.createDataFrame(cells, "lang string, gid long, tid long, n long")
    groups = spark.createDataFrame([("en", g + 1, int(whole[g]), 7, 45) for g in range(7)], "lang string, gid long, whole long, sources long, kept long")
    p = 1 + 1_000_000_000 * (counts + 5) // whole[:, None]
    want = {(g + 1, h + 1): int(np.abs(p[g] - p[h]).sum()) for g in range(7) for h in range(g + 1, 7)}
    for block_terms, block_groups in ((4096, 64), (8, 2), (16, 3)):
        got = divergence.group_distances(cells, groups, block_terms, block_groups)
        assert {(r.g, r.h): r.cost for r in got.collect()} == want


def test_equal_subtrees_are_one_node():
    forest = divergence.Forest(np.array([[1, 2, 0, 0, 1, 2, 0, 0], [1, 2, 0, 0, 0, 0, 0, 0], [1, 2, 0, 0, 1, 2, 0, 0]]))
    assert forest.roots[0] == forest.roots[2] != forest.roots[1]
    assert [len(left) for left, _ in forest.levels] == [2, 2, 2]


def test_counts_beyond_64_bits():
    big = np.array([10**10, 3], dtype=np.int64)
    assert divergence.shares(big, np.array([10**11, 50])).tolist() == [1 + 10**9 * (10**10 + 5) // 10**11, 1 + 10**9 * 8 // 50]
