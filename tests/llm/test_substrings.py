"""Substring dedup against looking every window up in a plain table."""

import random
import re

import numpy as np
import pytest

from pandekt.llm import substrings
from tests.llm import brute

NULL = -(1 << 63)


def plain(rows, window=20):
    """rows: (doc_id, text); returns sorted (doc_id, n_words, n_removed, text)."""
    docs = [(i, re.findall(brute.SPACE, t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - window + 1):
            key, at = tuple(w[s:s + window]), (NULL if i is None else i, s)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (NULL if i is None else i, s):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeÄéñ") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(70)]
    base = [word() for _ in range(150)]
    out = [None, "", " \n\t ", "x", " ".join(passage), " ".join(passage[:20]), " ".join(passage[:19]), " ".join(passage[30:51]), "\t".join(passage).upper()]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(w))
            w[k:k + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.5:
            k = rng.randrange(len(w))
            w[k:k] = passage[rng.randrange(40):][: rng.randint(5, 50)]
        out.append(" ".join(w[rng.randrange(30):]))
    out += ["la " * 300, "la le " * 100 + "lu", " ".join(base[:40] * 6), " ".join(word() for _ in range(30_000)), " ".join(rng.choices("ab", k=400)), "\n".join(rng.choices("abc", k=3000))]
    return out + out[9:20] + [out[9]] * 5


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window,k,slice_bytes", [(20, 8, 1 << 23), (20, 8, 3000), (5, 3, 1 << 23), (20, 20, 500), (1, 1, 1 << 23)])
def test_against_every_window(spark, monkeypatch, window, k, slice_bytes):
    monkeypatch.setattr(substrings, "SLICE_BYTES", slice_bytes)
    rows = [((37 * i) % 101, t) for i, t in enumerate(texts())]
    assert len({i for i, _ in rows}) == len(rows)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, content string, start int, n int").repartition(3)
    got = substrings.dedup_substrings(df, window=window, k=k)
    assert result(got) == plain(rows, window)


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(25))
    rows = [(None, t), (None, t), (None, "other words"), (1, t), (1, t), (2, f"{t} {t}"), (2, f"x {t}"), (2, f"{t} y"), (3, "short")]
    got = substrings.dedup_substrings(spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, note string").repartition(4), carry=("note",))
    assert result(got) == plain(rows)
    assert got.columns == ["doc_id", "note", "text", "n_words", "n_removed", "spans"] and {r.note for r in got.collect()} == {"kept"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup_substrings(df).count() == 0 and substrings.factors(df).count() == 0


def test_factors_are_copies_and_cover_what_is_removed(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = {i: re.findall(brute.SPACE, t or "") for i, t in rows}
    removed = {i: set() for i in words}
    for f in substrings.factors(df).collect():
        assert f.n_words >= 20 and (f.ref_doc, f.ref_start) < (f.doc_id, f.start)
        assert words[f.doc_id][f.start:f.start + f.n_words] == words[f.ref_doc][f.ref_start:f.ref_start + f.n_words]
        removed[f.doc_id].update(range(f.start, f.start + f.n_words))
    assert sorted((i, len(w), len(removed[i]), " ".join(x for j, x in enumerate(w) if j not in removed[i])) for i, w in words.items()) == sorted(plain(rows))


def test_a_whole_copy_is_one_factor():
    start, n = np.array([12, 0, 7]), np.array([3, 7, 5])
    assert substrings.greedy_factors(start, n, np.array([4, 4, 4]), start + 2, 20) == [(0, 34, 4, 2)]
    assert substrings.greedy_factors(start, n, np.array([4, 4, 5]), start + 2, 20) == [(0, 26, 4, 2), (7, 24, 5, 9), (12, 22, 4, 14)]
