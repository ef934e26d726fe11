import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pandekt.operators import curation as cu
from pandekt.operators import evaluation as ev
from pandekt.operators import quantiles as qt
from pandekt.sources import index as ix
from tests.conftest import rows


@pytest.fixture(scope="module")
def run(spark):
    gold = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "z"), ("d", "w")], "qid string, chunk_id string")
    hits = spark.createDataFrame([("a", "s", 1, "n", 9.0), ("a", "s", 2, "x", 8.0), ("a", "s", 11, "y", 8.0), ("b", "s", 1, "q", 1.0), ("c", "s", 1, "q", 3.0), ("d", "s", 1, "w", 2.0)],
                                 "qid string, setup string, rank bigint, chunk_id string, score double")
    queries = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "qid string")
    return queries, gold, hits


def test_metrics(run):
    q, g, h = run
    m = {r.qid: r for r in ev.query_metrics(q, g, h, ["s"]).collect()}
    assert (m["a"].r5, m["a"].r10, m["a"].r20, m["a"].mrr, m["a"].first_gold_rank) == (0.5, 0.5, 1.0, 0.5, 2)
    assert m["a"].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-9)
    assert m["b"].r10 == 0 and m["b"].mrr == 0 and m["b"].first_gold_rank is None and m["c"].r10 is None and m["c"].n_gold == 0 and m["d"].ndcg == 1
    z = {r.qid: r.r10 for r in ev.query_metrics(q, g, h, ["s"], empty=0.0).collect()}
    assert z["c"] == 0.0
    assert rows(ev.zero_recall(g, h, ["s"])) == [("b", "s")]
    assert rows(ev.boundary_fragile(h, g)) == [("a", "s")]
    means = ev.setup_means(ev.query_metrics(q, g, h, ["s"])).first()
    assert means.n_positive == 3 and means.n_empty == 1 and means.r10 == 0.5


def test_percentile_conventions(spark):
    rng = np.random.default_rng(2)
    data = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 37), ("d", 100)) for x in np.round(rng.normal(size=n), 1)]
    df = spark.createDataFrame(data, "g string, v double").unionByName(spark.createDataFrame([("a", None), ("e", None)], "g string, v double"))
    vals = {g: sorted(v for k, v in data if k == g) for g in "abcd"}
    for limit in (10**6, 5):
        d = {r.g: r for r in qt.describe(df, ["g"], "v", limit).collect()}
        assert d["e"].n == 0 and d["e"].mean is None and d["e"].median is None
        lin = {r.g: r for r in ev.percentile_linear(df, ["g"], "v", {"p50": .5, "p95": .95}, limit).collect()}
        near = {r.g: r for r in ev.percentile_nearest(df, ["g"], "v", {"p50": 50, "p90": 90}, limit).collect()}
        exc = {r.g: r for r in ev.quartiles_exclusive(df, ["g"], "v", limit).collect()}
        for g, s in vals.items():
            n = len(s)
            assert d[g].median == pytest.approx(statistics.median(s)) and d[g].std == pytest.approx(statistics.pstdev(s))
            assert d[g].p10 == s[max(0, int(.1 * n) - 1)] and d[g].p90 == s[min(n - 1, int(.9 * n))]
            assert lin[g].p95 == pytest.approx(np.percentile(s, 95)) and near[g].p90 == s[int(round(.9 * (n - 1)))] and near[g].max == s[-1]
            want = statistics.quantiles(s, n=4) if n > 1 else [s[0]] * 3
            assert (exc[g].p25, exc[g].p75) == (pytest.approx(want[0]), pytest.approx(want[2]))
    assert qt.describe(df, [], "v").first().n == 140


def test_selection_by_ranges(spark):
    rng = np.random.default_rng(8)
    inf, nan = float("inf"), float("nan")
    groups = {
        "even": rng.uniform(-5, 5, 3000).tolist(), "ties": rng.integers(0, 3, 2000).astype(float).tolist(), "one": [7.0] * 500,
        # Values crowded at one end need many rounds, the rest is ordered.
        "steep": [2.0**-k for k in range(900)] + [1e308, -1e308], "odd": [inf, -inf, nan, nan, 0.0, -0.0, 5e-324] * 20, None: rng.normal(size=300).tolist(),
    }
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("nulls", None)], "g string, v double")
    # Ranks at both ends, inside and outside of the group.
    rules = {"first": lambda n: F.lit(1), "mid": qt.lower_median, "last": lambda n: n, "p90": qt.nearest_rank(90), "none": lambda n: n + 1}
    for limit in (10**6, 64):
        got = {r.g: r for r in qt.order_stats(df, ["g"], "v", rules, limit).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            s, n, r = sorted(xs, key=lambda x: (x != x, x if x == x else 0)), len(xs), got[g]
            for label, rank in (("first", 1), ("mid", (n + 1) // 2), ("last", n), ("p90", round(0.9 * (n - 1)) + 1)):
                assert r[label] == s[rank - 1] or (r[label] != r[label] and s[rank - 1] != s[rank - 1]), (g, label, limit)
            assert r.n == n and r.none is None
    # Whole numbers that doubles can't tell apart.
    whole = spark.range(2**60, 2**60 + 400).select((F.col("id") * 1).alias("v"))
    assert qt.order_stats(whole, [], "v", {"m": lambda n: F.lit(123)}, 50).collect() == [(400, 2**60 + 122)]
    assert qt.order_stats(whole.limit(0), [], "v", {"m": qt.lower_median}).collect() == []
    plan = qt.order_stats(df.filter("g <> 'steep'"), ["g"], "v", {"mid": qt.lower_median}, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_limit_phrases(spark):
    yes = ["Il tema non è incluso nel corpus normativo di riferimento.", "Norme NON PRESENTI in questo corpus", "il contesto normativo non contiene", "contesto fornito non include",
           "il contesto non riguarda", "assenti nel contesto", "non presenti nel contesto", "sarebbe necessario\nconsultare"]
    no = ["il contesto storico non riguarda", "la norma si applica"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in yes + no], "a string").select(ev.declares_limit(F.col("a"))).collect()]
    assert got == [True] * 8 + [False] * 2


def test_budget_and_subset(spark):
    calls = spark.createDataFrame([(i, 1.0) for i in range(100)], "i int, cost double")
    for limit in (10**6, 20):
        w = ev.budget_watch(calls, ["i"], "cost", 50.0, 80, limit)
        assert ev.first_breach(w).first() == (80, 21)
    wanted = spark.createDataFrame([(1, 7), (2, 3)], "pos int, i int")
    assert [r.i for r in ev.subset_filter(calls, wanted, "i").orderBy("pos").collect()] == [7, 3]
    with pytest.raises(KeyError):
        ev.subset_filter(calls, spark.createDataFrame([(1, 700)], "pos int, i int"), "i")


def test_gold_gates(spark):
    c = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "qid string, chunk_id string")
    g1, g2 = c.filter("qid = 'a' and chunk_id = 'x'"), c.filter("qid = 'b'")
    assert rows(cu.checked_gold(c, [g1, g2])) == [("a", "x", True), ("a", "y", False), ("b", "x", True)]
    with pytest.raises(ValueError):
        cu.checked_gold(c, [g1, g1])
    with pytest.raises(ValueError):
        cu.checked_gold(c, [spark.createDataFrame([("a", "nope")], c.schema)])


def test_best_overlap_is_exact(spark):
    rng = np.random.default_rng(11)
    vocab = [f"w{i:03d}a" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    weights /= weights.sum()
    make = lambda p, n: [(f"{p}{i}", " ".join(rng.choice(vocab, rng.integers(3, 14), p=weights)), [list("ABC")[j] for j in range(3) if rng.random() < .4]) for i in range(n)]
    new, old = make("n", 60) + [("nz", "mai visto", ["A"]), ("ny", "w001a", ["Z"])], make("o", 80)
    schema = "qid string, text string, norms array<string>"
    got = {r.qid: r for r in cu.best_overlap(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), probe=1).collect()}
    assert len(got) == len(new)
    for qid, text, norms in new:
        w, s = set(text.split()), set(norms)
        same = [o for o in old if o[2] and set(o[2]) == s]
        pool = same or [o for o in old if set(o[2]) & s]
        best = min(((-round(len(w & set(t.split())) / len(w | set(t.split())), 9), i) for i, t, _ in pool), default=None)
        r = got[qid]
        if best is None:
            assert r.flag == "new_area" and r.jaccard == 0
        elif best[0] == 0:
            assert r.jaccard == 0 and r.flag == "distinct"
        else:
            assert (r.old_qid, r.jaccard) == (best[1], -best[0])


def test_overlap_stays_linear_where_nothing_matches(spark, monkeypatch):
    """Most new questions share one frequent word with every old one and nothing else."""
    n = 400
    schema = "qid string, text string, norms array<string>"
    new = [(f"n{i}", f"comune nuova{i} altra{i} terza{i}", ["A"]) for i in range(n)] + [("hit", "comune vecchia7 parola7", ["A"])]
    old = [(f"o{i:03d}", f"comune vecchia{i} parola{i} lunga{i}" + (" coda" if i % 2 else ""), ["A"]) for i in range(n)]
    sizes = []
    cut = cu.cut_lineage

    def counted(df):
        df = cut(df)
        if df.columns == ["qid", "old_qid", "jaccard"]:
            sizes.append(df.count())
        return df

    monkeypatch.setattr(cu, "cut_lineage", counted)
    got = {r.qid: r for r in cu.best_overlap(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), probe=1).collect()}
    assert (got["hit"].old_qid, got["hit"].shared) == ("o007", ["comune", "parola7", "vecchia7"])
    assert (got["n3"].old_qid, got["n3"].jaccard) == ("o000", round(1 / 7, 9)) and len(got) == n + 1
    assert max(sizes) < 3 * n


def test_rewrite_and_notes(spark):
    l = spark.createDataFrame([("q", 1, "a"), ("q", 2, "art_38"), ("q", 3, "b")], "qid string, pos int, chunk_id string")
    m = spark.createDataFrame([("art_38", 0, "art_38__paras_1_11"), ("art_38", 1, "art_38__paras_12_16")], "chunk_id string, new_pos int, new_id string")
    assert [r.chunk_id for r in cu.rewrite_ids(l, m).orderBy("pos").collect()] == ["a", "art_38__paras_1_11", "art_38__paras_12_16", "b"]
    d = spark.createDataFrame([("",), ("x",), (None,)], "n string")
    assert [r[0] for r in d.select(cu.append_note(F.col("n"), "y")).collect()] == ["y", "x | y", "y"]


def test_links(spark):
    good = '{"from":"a","to":"b","relation":"attua","note":"n"}'
    bad = ['{"from":"a","to":"b","relation":"boh","note":"n"}', '{"from":"a","to":"b","relation":"attua"}', '{"from":"a","to":"b","relation":"attua","note":"n","peso":1}',
           '{"from":"a","to":"b","relation":"attua","note":"n","source":"altro"}']
    df = lambda *x: spark.createDataFrame([(s,) for s in x], "j string")
    assert [r.violation for r in ix.parse_links(df(good, *bad), "j").collect()] == [None, "relation", "missing_field", "unknown_field", "source"]
    assert ix.load_links(df(good), "j").first().source == "curated"
    for rows_ in ([bad[0]], [good, good]):
        with pytest.raises(ValueError):
            ix.load_links(df(*rows_), "j")


def test_medians_make_their_input_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        made.add(1)
        return float(i)

    df = spark.range(101).select((F.col("id") % 2).alias("g"), value("id").alias("v"))
    assert {(r.g, r.v) for r in ev.medians(df, ["g"], ["v"], max_rows=10).collect()} == {(0, 50.0), (1, 50.0)}
    assert made.value == 101
