import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pandekt.operators import candidates as cd
from pandekt.operators import fusion, graph
from pandekt.operators.dense import dense_topk
from pandekt.operators.embedding import embed
from pandekt.operators.postings import posting_blocks
from pandekt.operators.sparse import sparse_topk
from pandekt.session import cut_lineage
from pandekt.session import cut_lineage as dense_cut
from pandekt.operators.understanding import detect_entities, expand_terms, fan_out, render_prompt, route
from tests.conftest import rows


@pytest.fixture(scope="module")
def corpus(spark):
    words = "alfa beta gamma delta dato legge norma art ente rischio".split()
    rng = np.random.default_rng(3)
    data = [(f"d{i % 4}__art_{i}", f"d{i % 4}", " ".join(rng.choice(words, 5 + i % 20))) for i in range(120)]
    data += [("d0__art_900", "d0", data[0][2]), ("d0__art_901", "d0", ""), ("d0__art_902", "d0", "unico")]
    q = [(f"Q{i}", " ".join(rng.choice(words, 3)), f"d{i % 5}" if i % 2 else None) for i in range(25)] + [("Q98", "assente", None), ("Q99", "", None)]
    return (spark.createDataFrame(q, "qid string, text string, want string"), spark.createDataFrame(data, "chunk_id string, doc_urn string, text string"))


def test_bm25_paths_agree(spark, corpus):
    q, c = corpus
    for want in (None, "want"):
        in_place = rows(sparse_topk(q, c, 7, filter_doc=want))
        assert in_place
        assert in_place == rows(sparse_topk(q, c, 7, filter_doc=want, block_rows=3))
        for shard_rows in (7, 8192):
            assert in_place == rows(sparse_topk(q, c, 7, filter_doc=want, postings=cut_lineage(posting_blocks(c, shard_rows=shard_rows))))
        assert in_place == rows(sparse_topk(q.repartition(5), c.repartition(17), 7, filter_doc=want))


def test_upper_bounds_never_lose_a_hit(spark, monkeypatch):
    """Long lists of frequent and rare words, blocks of four postings: pruned search against scoring everything."""
    from pandekt.operators import postings as po

    monkeypatch.setattr(po, "BLOCK", 4)
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=p / p.sum()))
    c = spark.createDataFrame([(i, f"d{i % 3}", draw(rng.integers(0, 60))) for i in range(400)], "chunk_id long, doc_urn string, text string")
    q = spark.createDataFrame([(i, draw(rng.integers(1, 12)), None if i % 2 else f"d{i % 4}") for i in range(40)], "qid long, text string, want string")
    blocks = cut_lineage(posting_blocks(c, shard_rows=150))
    for k in (1, 10, 1000):
        for want in (None, "want"):
            assert rows(sparse_topk(q, c, k, filter_doc=want)) == rows(sparse_topk(q, c, k, filter_doc=want, postings=blocks)) == rows(sparse_topk(q, c, k, filter_doc=want, postings=blocks, block_rows=9))


def test_a_search_of_ten_words_leaves_most_postings_unread(spark):
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    from pandekt.operators.search_index import write_postings
    from pandekt.session import scratch_path

    rng = np.random.default_rng(9)
    c = spark.range(3000).select(F.col("id").alias("chunk_id"), F.lit("d").alias("doc_urn"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(1), F.lit(60)), lambda j: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", j), F.lit(20_000)).cast("string")))).alias("text"))
    path = scratch_path(spark, "test-postings")
    write_postings(cut_lineage(posting_blocks(c, shard_rows=1000)), path, row_group=16 << 10)
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    words = {f"w{i}" for i in rng.integers(0, 20_000, 10)}
    whole = hit = 0
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.path.endswith(".parquet"):
            meta = pq.ParquetFile(fs.open_input_file(info.path)).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                term = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema == "term")
                whole += group.total_byte_size
                hit += group.total_byte_size * any(term.statistics.min <= w <= term.statistics.max for w in words)
    assert hit < 0.05 * whole
    plan = sparse_topk(spark.createDataFrame([(1, " ".join(words))], "qid long, text string"), c, 5, postings=spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term," in plan


def test_bm25_small_cuts(spark, corpus, monkeypatch):
    from pandekt.operators import sparse
    q, c = corpus
    whole = rows(sparse_topk(q, c, 5))
    monkeypatch.setattr(sparse, "MAX_PAIRS", 50)
    assert rows(sparse_topk(q, c, 5)) == whole


def test_dense_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 8))
    v[40] = v[41] = v[42]
    e = spark.createDataFrame(pd.DataFrame({"qid": np.arange(90), "vec": v.tolist(), "doc": [f"d{i % 3}" for i in range(90)]}))
    c = e.select(F.col("qid").alias("chunk_id"), "vec", F.col("doc").alias("doc_urn"))
    a = rows(dense_topk(e, c, 6, skip_same_id=True))
    assert a == rows(dense_topk(e, c, 6, skip_same_id=True, block_rows=20)) == rows(dense_topk(e, c.repartition(9), 6, skip_same_id=True))
    s = np.round(v @ v.T, 6)
    for i in range(90):
        best = sorted((-s[i, j], j) for j in range(90) if j != i)[:6]
        assert [r[2] for r in a if r[0] == i] == [j for _, j in best] or sorted(r[2] for r in a if r[0] == i) == sorted(j for _, j in best)
    f = rows(dense_topk(e, c, 4, filter_doc="doc"))
    assert f == rows(dense_topk(e, c, 4, filter_doc="doc", block_rows=20)) and all(r[0] % 3 == r[2] % 3 for r in f)


def test_cells_are_exact_and_left_out_where_they_cannot_help(spark, monkeypatch):
    """Tight groups of vectors of different length, ties and repeats; more questions than a block holds."""
    from pandekt.operators import dense

    rng = np.random.default_rng(12)
    centre = rng.normal(size=(20, 6)) * 5
    c = np.repeat(centre, 40, axis=0) + rng.normal(scale=0.05, size=(800, 6))
    c[100:110] = c[100]
    q = np.repeat(centre, 15, axis=0) + rng.normal(scale=0.3, size=(300, 6))
    frame = lambda v, name: spark.createDataFrame(pd.DataFrame({name: np.arange(len(v)), "vec": v.tolist(), "doc": [f"d{i % 3}" if i % 5 else None for i in range(len(v))]}))
    qs, cs = frame(q, "qid"), frame(c, "chunk_id").withColumnRenamed("doc", "doc_urn")
    for k in (1, 7, 1000):
        want = rows(dense_topk(qs, cs, k))
        assert want == rows(dense_topk(qs, cs, k, block_rows=40))
    assert rows(dense_topk(qs, cs, 4, filter_doc="doc")) == rows(dense_topk(qs, cs, 4, filter_doc="doc", block_rows=40))
    assert rows(dense_topk(qs, cs.limit(0), 4, block_rows=40)) == []
    visits = []
    monkeypatch.setattr(dense, "cut_lineage", lambda df: visits.append(df := dense_cut(df)) or df)
    dense_topk(qs, cs, 7, block_rows=40).count()
    asked = [v for v in visits if "qvec" in v.columns]
    cells = visits[0].select("cell").distinct().count()
    assert sum(v.count() for v in asked) < 0.6 * 300 * cells


def test_custom_encoder_is_normalised(spark):
    def encoder(batches):
        for b in batches:
            yield b.map(lambda s: [3.0, 4.0 if s.endswith("x") else 0.0])
    got = embed(spark.createDataFrame([("x",), ("y",)], "text string"), encoder=encoder).collect()
    assert [[round(x, 6) for x in r.vec] for r in got] == [[0.6, 0.8], [1.0, 0.0]]


def test_fusion(spark):
    r = spark.createDataFrame([(1, "norm:a", 0, 1, "x", "pa"), (1, "norm:a", 0, 2, "y", "pb"), (1, "global", 1, 2, "x", "pc"), (1, "global", 1, 1, "z", "pd")],
                              "qid int, source string, source_pos int, rank int, chunk_id string, payload string")
    out = fusion.fuse_sources(r, 20, payload="payload").orderBy("rank").collect()
    assert [(x.chunk_id, x.payload) for x in out] == [("x", "pa"), ("z", "pd"), ("y", "pb")]
    assert out[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)
    tr = fusion.fusion_trace(r).filter("chunk_id = 'x'").first().contributions
    assert [(c.source, c.rank) for c in tr] == [("norm:a", 1), ("global", 2)]


def test_argument_checks(corpus):
    q, c = corpus
    for bad in (dict(k=0), dict(k=-1), dict(k=5, rerank_k=3), dict(k=5, mode="fuzzy")):
        with pytest.raises(ValueError):
            fusion.retrieve(q, c, **bad)


def test_retrieve_modes_and_self_join(spark, corpus):
    q, c = corpus
    for mode in fusion.MODES:
        hits, more = fusion.retrieve(q, c, 5, mode, rerank_k=10)
        assert more is None
        by = {}
        for r in hits.collect():
            by.setdefault(r.qid, []).append(r.rank)
        assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 5 for v in by.values())
        twice = hits.join(hits.withColumnRenamed("rank", "r2").select("qid", "chunk_id", "r2"), ["qid", "chunk_id"])
        assert twice.filter("rank = r2").count() == hits.count()


EDGES = "from_chunk string, to_chunk string, relation string, note string, link_pos int"


def hop(spark, hits, edges, cap=5):
    h = spark.createDataFrame([("q", i + 1, c, 1.0) for i, c in enumerate(hits)], "qid string, rank bigint, chunk_id string, score double")
    e = spark.createDataFrame([(a, b, rel, "n", i) for i, (a, b, rel) in enumerate(edges)], EDGES)
    return [(r.chunk_id, r.expanded_from, r.relation, r.source_rank) for r in graph.expand_one_hop(h, e, cap).orderBy("source_rank", "chunk_id").collect()]


def test_one_hop(spark):
    edges = [("a", "b", "attua"), ("c", "d", "deroga"), ("a", "e", "rinvia_a"), ("b", "e", "attua")]
    assert hop(spark, ["a", "b"], edges) == [("e", "a", "rinvia_a", 1)]
    assert hop(spark, ["d"], edges) == [("c", "d", "deroga", 1)]
    fan = [(f"s{i}", f"t{i}", "attua") for i in range(5)]
    assert [x[3] for x in hop(spark, [f"s{i}" for i in range(5)], fan, 2)] == [1, 2]
    assert [x[0] for x in hop(spark, ["s"], [("s", "zebra", "attua"), ("s", "alpha", "attua"), ("mango", "s", "attua")])] == ["alpha", "mango", "zebra"]
    assert hop(spark, ["a"], edges, 0) == [] and hop(spark, [], edges) == [] and hop(spark, ["a"], []) == []
    assert hop(spark, ["s"], [("s", "t", "deroga"), ("s", "t", "attua")])[0][2] == "deroga"


def test_hub_pruning_is_exact(spark):
    hub = [("hub", f"n{i:03d}", "attua") for i in range(200)]
    hits = ["hub"] + [f"n{i:03d}" for i in range(9)]
    assert [x[0] for x in hop(spark, hits, hub)] == [f"n{i:03d}" for i in range(9, 14)]


def test_more_hits_than_any_bound(spark):
    hub = [("hub", f"n{i:03d}", "attua") for i in range(200)]
    hits = [f"n{i:03d}" for i in range(60)] + ["hub"]
    assert [x[0] for x in hop(spark, hits, hub)] == [f"n{i:03d}" for i in range(60, 65)]


def test_retrieve_expands_aliases(spark):
    q = spark.createDataFrame([("Q", "fria")], "qid string, text string")
    c = spark.createDataFrame([("d__art_1", "d", "valutazione d'impatto sui diritti fondamentali"), ("d__art_2", "d", "altro")], "chunk_id string, doc_urn string, text string")
    assert [r.chunk_id for r in fusion.retrieve(q, c, 5, "sparse")[0].collect()] == ["d__art_1"]
    assert fusion.retrieve(q, c, 5, "sparse", aliases={})[0].count() == 0


def test_stored_index_gives_the_same_hits(spark, corpus):
    from pandekt.operators.search_index import build_index, open_index
    from pandekt.session import scratch_path
    q, c = corpus
    path = scratch_path(spark, "test-index")
    build_index(c, path)
    index = open_index(spark, path)
    for mode in fusion.MODES:
        for want in (None, "want"):
            assert rows(fusion.retrieve(q, c, 6, mode, filter_doc=want)[0]) == rows(fusion.retrieve(q, c, 6, mode, filter_doc=want, index=index)[0])


def test_cross_rankings_have_their_own_depths(spark):
    words = ["norma", "legge", "dato", "ente", "rischio"]
    c = spark.createDataFrame([(f"d{i % 2}__art_{i}", f"d{i % 2}", " ".join(words[: 1 + i % 5])) for i in range(60)], "chunk_id string, doc_urn string, text string")
    q = spark.createDataFrame([("Q", "norma rischio", ["a", "b"])], "qid string, text string, entities array<string>")
    glossary = spark.createDataFrame([("a", "d0"), ("b", "d1")], "norm_id string, doc_urn string")
    subs = spark.createDataFrame([("Q", "a", "norma legge"), ("Q", "b", "dato")], "qid string, norm_id string, text string")
    got = fusion.cross_rankings(q, c, glossary, subs, 3, 9, "hybrid")
    alone = fusion.retrieve(q.select("qid", "text"), c, 9, "hybrid")[0]
    assert rows(got.filter("source = 'global'").select("rank", "chunk_id", "score")) == rows(alone.select("rank", "chunk_id", "score"))
    own = fusion.retrieve(spark.createDataFrame([("Q", "norma legge", "d0")], "qid string, text string, w string"), c, 3, "hybrid", filter_doc="w")[0]
    assert rows(got.filter("source = 'norm:a'").select("rank", "chunk_id", "score")) == rows(own.select("rank", "chunk_id", "score"))


def test_expand_terms(spark):
    d = spark.createDataFrame([("Cos'è la fria?",), ("Il frialdo non c'entra niente.",), ("Uno scoring Creditizio e DPIA",)], "q string")
    once = d.select(expand_terms(F.col("q")).alias("q"))
    got = [r.q for r in once.collect()]
    assert got[0] == "Cos'è la fria? valutazione d'impatto sui diritti fondamentali" and got[1] == "Il frialdo non c'entra niente."
    assert got[2].endswith(" valutazione d'impatto sulla protezione dei dati merito di credito")
    assert [r.q for r in once.select(expand_terms(F.col("q")).alias("q")).collect()] == got


def test_detect_and_fan_out(spark):
    d = spark.createDataFrame([("Q69", "Rapporto fra NIS2, GDPR e AI Act"), ("Q2", "Solo il Reg. (UE) 2016/679"), ("Q3", "niente"), ("Q4", "D.Lgs. 231/2001 e Codice Privacy; L. 132/2025; D. Lgs. n. 138/2024")], "qid string, text string")
    e = d.withColumn("entities", detect_entities(F.col("text")))
    got = {r.qid: (r.entities, r.p) for r in e.withColumn("p", route(F.col("entities"))).collect()}
    assert got == {"Q69": (["gdpr", "ai_act", "nis2"], "multi"), "Q2": (["gdpr"], "fallback"), "Q3": ([], "fallback"),
                   "Q4": (["dlgs_231", "nis2", "codice_privacy", "l_132_2025"], "multi")}
    g = spark.createDataFrame([("gdpr", "u1"), ("ai_act", "u2"), ("nis2", None)], "norm_id string, doc_urn string")
    assert [r.source for r in fan_out(e.filter("qid = 'Q69'"), g).orderBy("source_pos").collect()] == ["norm:gdpr", "norm:ai_act", "global"]


def test_cross_retrieval(spark, corpus):
    _, c = corpus
    q = spark.createDataFrame([("Q1", "GDPR e AI Act: norma ente"), ("Q2", "GDPR norma ente")], "qid string, text string")
    g = spark.createDataFrame([("gdpr", "d1"), ("ai_act", "d2")], "norm_id string, doc_urn string")
    sub = spark.createDataFrame([("Q1", "gdpr", "norma"), ("Q1", "ai_act", "ente")], "qid string, norm_id string, text string")
    out = fusion.retrieve_cross(q, c, g, sub, 3, 2, 20, mode="sparse").collect()
    one = sorted((r for r in out if r.qid == "Q1"), key=lambda r: r.rank)
    assert {r.path for r in one} == {"multi"} and {r.path for r in out if r.qid == "Q2"} == {"fallback"}
    assert [r.rank for r in one] == list(range(1, len(one) + 1)) and all(a.score >= b.score for a, b in zip(one, one[1:]))
    want = {}
    for text, doc, k in (("norma", "d1", 3), ("ente", "d2", 3), ("GDPR e AI Act: norma ente", None, 2)):
        part = c if doc is None else c.filter(F.col("doc_urn") == doc)
        ask = spark.createDataFrame([("x", text, doc)], "qid string, text string, want string")
        for r in sparse_topk(ask, c, k, filter_doc="want").collect():
            want[r.chunk_id] = want.get(r.chunk_id, 0) + 1 / (60 + r.rank)
        assert part.count() > 0
    assert {r.chunk_id: r.score for r in one} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    plain = rows(sparse_topk(q.filter("qid = 'Q2'"), c, 20).select("chunk_id", "rank"))
    assert sorted(((r.chunk_id, r.rank) for r in out if r.qid == "Q2"), key=repr) == plain
    with pytest.raises(ValueError):
        fusion.retrieve_cross(q, c, g, sub, 0)


def test_prompt_template(spark):
    d = spark.createDataFrame([("N", ["a", "b"], "domanda {short_name}")], "s string, v array<string>, q string")
    got = d.select(render_prompt("<{short_name}|{bullets}|{query}|{short_name}>", F.col("s"), F.col("v"), F.col("q"))).first()[0]
    assert got == "<N|- a\n- b|domanda {short_name}|N>"


def test_terms(spark):
    c = spark.createDataFrame([("a", "Dato dato DATO"), ("b", "il dato"), ("c", "aaaa aa"), ("d", "")], "chunk_id string, text string")
    t = spark.createDataFrame([("q1", "Dato"), ("q2", "aa"), ("q3", "manca")], "qid string, term string")
    want = [("q1", "Dato", 1, "a", 3, 1.0), ("q1", "Dato", 2, "b", 1, 0.5), ("q2", "aa", 1, "c", 3, 1.5)]
    assert rows(cd.term_frequency_rank(c, t)) == rows(spark.createDataFrame(want))


def test_hints(spark):
    c = spark.createDataFrame([("u__art_5",), ("u__art_5__paras_1_2",), ("u__art_50",), ("u__recital_5",), ("u__recital_5__paras_1_1",)], "chunk_id string")
    h = spark.createDataFrame([("q", "u", "art_5"), ("q", "u", "recital_5")], "qid string, doc_urn string, suffix string")
    assert [r[3] for r in rows(cd.match_hints(h, c))] == ["u__art_5", "u__art_5__paras_1_2", "u__recital_5"]


def test_mining_without_retrieval(spark):
    c = spark.createDataFrame([("a", "testo"), ("b", "altro")], "chunk_id string, text string")
    hints = spark.createDataFrame([("q", "b", "gdpr/art_1")], "qid string, chunk_id string, label string")
    terms = spark.createDataFrame([("q", "a", "t1"), ("q", "b", "t1"), ("q", "a", "t1")], "qid string, chunk_id string, term string")
    assert rows(cd.mine_candidates(c, hints, terms).select("chunk_id", "hint_backed", F.array_join("found_via", "|"))) == [
        ("a", False, "term:t1"), ("b", True, "hint:gdpr/art_1|term:t1")]


def test_terms_inside_words_over_words_and_of_white_space(spark):
    rng = np.random.default_rng(4)
    letters = list("abAB \n\té.")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(80)] + ["", None, "aaaaaa", "İstanbul", "a  b"]
    terms = sorted({"".join(rng.choice(letters, rng.integers(1, 6))) for _ in range(60)} | {"", " ", "  ", "aa", "zz", "abcde fghij", "a" * 7, "İ"})
    lower = dict(spark.createDataFrame([(x,) for x in {*terms, *(t for t in texts if t)}], "s string").select("s", F.lower("s")).collect())
    want = {(i, w, lower[t].count(w)) for i, t in enumerate(texts) if t for w in {lower[x] for x in terms if x} if w in lower[t]}
    got = cd.term_occurrences(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {(r.chunk_id, r.term, r.n) for r in got.collect()} == want and got.count() == len(want)
    assert cd.term_occurrences(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"), spark.createDataFrame([("",)], "term string")).count() == 0


def test_key_tables(spark):
    from pandekt.operators import keys as ky

    t = spark.createDataFrame([(1, "Cos'è la FRIA? Scoring creditizio!"), (2, "frialdo e scoring-creditizio, DPIA"), (3, ""), (4, None), (5, "fria: Merito di Credito")], "qid long, text string")
    a = spark.createDataFrame([(0, "FRIA", ["valutazione"]), (1, "scoring creditizio", ["merito di credito", "Valutazione"]), (2, "...", ["mai"]), (3, "credito", ["valutazione", "prestito"])], "alias_pos int, key string, forms array<string>")
    got = {r.qid: r.expanded for r in ky.expand_terms_by(t, a).collect()}
    assert got == {1: "Cos'è la FRIA? Scoring creditizio! valutazione merito di credito", 2: "frialdo e scoring-creditizio, DPIA merito di credito Valutazione", 3: "", 4: None,
                   5: "fria: Merito di Credito valutazione prestito"}
    n = spark.createDataFrame([(0, "x", "scoring creditizio"), (1, "y", "fria"), (2, "x", "dpia")], "entity_pos int, entity string, name string")
    assert {r.qid: r.entities for r in ky.detect_entities_by(t, n).collect()} == {1: ["x", "y"], 2: ["x"], 3: [], 4: [], 5: ["y"]}


def test_walks_meet_only_the_lists_they_may_reach(spark):
    """A list that always completes a question ends its walk; shorter ones, shared and own neighbours don't."""
    edges = [("full", f"n{i:02d}", "r", "", i) for i in range(9)] + [("h1", "n00", "r", "", 1), ("h1", "h2", "r", "", 2), ("h2", "n00", "r", "", 3), ("h2", "n01", "r", "", 4), ("h2", "n02", "r", "", 5)]
    hits = [("a", 1, "full"), ("a", 2, "h1"), ("a", 3, "h2"), ("b", 1, "h1"), ("b", 2, "alone"), ("b", 3, "h2"), ("c", 1, "h2"), ("c", 2, "full"), ("c", 3, "h1"), ("d", 1, "alone")]
    e = spark.createDataFrame(edges, "from_chunk string, to_chunk string, relation string, note string, link_pos long")
    h = spark.createDataFrame(hits, "qid string, rank long, chunk_id string").withColumn("score", F.lit(1.0))
    near = {}
    for a, b, *_ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for q in "abcd":
        own, taken = [n for x, _, n in hits if x == q], []
        for rank, node in sorted((r, n) for x, r, n in hits if x == q):
            taken += [(n, node, rank) for n in sorted(near.get(node, ())) if n not in own and n not in [t[0] for t in taken]]
        want |= {(q, *t) for t in taken[:3]}
    got = graph.expand_one_hop(h, e, 3).collect()
    assert {(r.qid, r.chunk_id, r.expanded_from, r.source_rank) for r in got} == want and len(got) == len(want)
    own = h.select("qid", F.col("rank").alias("source_rank"), F.col("chunk_id").alias("node"))
    sizes = spark.createDataFrame([(n, min(len(x), 6)) for n, x in near.items()], "node string, _len int")
    reached = {(r.qid, r.node) for r in graph.reached_hits(own, sizes, 3).collect()}
    assert reached == {("a", "full"), ("b", "h1"), ("b", "h2"), ("c", "h2"), ("c", "full")}


def plain_hops(hits, edges, cap):
    """Rows of expand_one_hop by loops, without the note."""
    near = {}
    for a, b, rel, _, pos in edges:
        for node, other, way in ((a, b, 0), (b, a, 1)):
            near.setdefault(node, {}).setdefault(other, []).append((pos, way, rel))
    out = set()
    for q in {h[0] for h in hits}:
        own, taken = {n for x, _, n in hits if x == q}, {}
        for rank, node in sorted((r, n) for x, r, n in hits if x == q):
            for other, links in sorted(near.get(node, {}).items()):
                if other not in own and other not in taken and len(taken) < cap:
                    taken[other] = (q, other, node, min(links)[2], rank)
        out |= set(taken.values())
    return out


def test_one_hop_from_first_and_later_lists(spark):
    """Short and long lists, links of a node to itself, parallel links and hits outside the graph."""
    rng = np.random.default_rng(11)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 40, (90, 2))] + [("n0", f"m{i:02d}") for i in range(30)] + [("n1", "n1")]
    pairs += pairs[:20] + [(b, a) for a, b in pairs[20:40]]
    edges = [(a, b, f"r{i % 3}", "", i) for i, (a, b) in enumerate(pairs)]
    hits = [(f"q{q}", r + 1, f"n{n}") for q in range(60) for r, n in enumerate(rng.permutation(45)[:1 + q % 7])]
    h = spark.createDataFrame([(*x, 1.0) for x in hits], "qid string, rank long, chunk_id string, score double")
    got = graph.expand_one_hop(h, spark.createDataFrame(edges, EDGES), 4).drop("note").collect()
    assert {tuple(r) for r in got} == plain_hops(hits, edges, 4) and len(got) == len({tuple(r) for r in got})
    single = list({tuple(sorted(x[:2])): x for x in edges}.values())
    got = graph.expand_one_hop(h, spark.createDataFrame(single, EDGES), 4, parallel=False).drop("note").collect()
    assert {tuple(r) for r in got} == plain_hops(hits, single, 4)
    walks = graph.question_walks(h)
    first = {r.qid: r for r in graph.first_expansions(walks, graph.adjacency_lists(spark.createDataFrame(edges, EDGES), 11), 4).collect()}
    assert len(first) == 60 and {(r._new is None) for r in first.values()} == {True, False}
    assert all((r._new is None) != (r._own is None) for r in first.values())


def test_lists_do_not_travel_to_questions_that_end_at_their_best_hit(spark):
    """Without broadcasts 3.2 MB are shuffled; with the lists sent on by question it was 8.2."""
    gate, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def moved():
        stages = store.stageList(gate.jvm.java.util.ArrayList(), False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    edges = cut_lineage(spark.range(40_000).selectExpr("concat('P', id div 40) from_chunk", "concat('S', id % 40, '_', id div 4000) to_chunk", "'r' relation", "'' note", "id link_pos"))
    hits = cut_lineage(spark.range(160_000).selectExpr("id div 8 qid", "id % 8 + 1 rank", "concat('P', id * 7919 % 1000) chunk_id", "1.0D score"))
    before, kept = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert graph.expand_one_hop(hits, edges, 5).count() == 100_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    mb = sum(n for k, n in moved().items() if k not in before) / 1e6
    assert mb < 6


def test_known_number_of_hits_saves_writing_them(spark):
    """Lists and first expansions are written, hits only where they must be counted; the rows are the same."""
    from pandekt import session

    edges = [(f"n{i % 9}", f"m{i:02d}", "r", "", i) for i in range(40)]
    hits = [(f"q{q}", r + 1, n) for q in range(20) for r, n in enumerate([f"n{q % 11}", f"m{q:02d}", f"n{q % 7}"][:1 + q % 3])]
    hits = list({(q, n): (q, r, n) for q, r, n in reversed(hits)}.values())
    h, e = spark.createDataFrame([(*x, 1.0) for x in hits], "qid string, rank long, chunk_id string, score double"), spark.createDataFrame(edges, EDGES)
    written = []
    for most in (None, 3, 10):
        before = len(session._scratch)
        got = graph.expand_one_hop(h, e, 4, most_hits=most).drop("note").collect()
        written.append(len(session._scratch) - before)
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == plain_hops(hits, edges, 4)
    assert written == [3, 2, 2]


def test_no_second_walk_when_all_questions_end_at_their_best_hit(spark):
    """The plan then holds no join; with one question that needs more lists it does."""
    edges = spark.createDataFrame([("a", f"m{i}", "r", "", i) for i in range(6)] + [("b", "z", "r", "", 9)], EDGES)
    for hits, joined in (([("q", 1, "a"), ("q", 2, "b"), ("alone", 1, "b"), ("out", 1, "x")], False), ([("q", 1, "a"), ("p", 1, "b"), ("p", 2, "a")], True)):
        h = spark.createDataFrame([(*x, 1.0) for x in hits], "qid string, rank long, chunk_id string, score double")
        got = graph.expand_one_hop(h, edges, 3)
        assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == joined
        assert {tuple(r) for r in got.drop("note").collect()} == plain_hops(hits, [(*r,) for r in edges.collect()], 3)
    assert graph.expand_one_hop(h.limit(0), edges, 3).count() == 0


def test_keys_that_begin_alike_meet_only_their_own_texts(spark):
    from pandekt.functions.text import words
    from pandekt.operators import keys as ky

    n, tail = 300, " ".join(f"w{i}" for i in range(ky.RUN))
    texts = [(i, f"Have small ring {i}, or SMALL RING {i + 7}!") for i in range(n)] + [(n, f"see {tail} ends {tail} other"), (n + 1, f"{tail}"), (n + 2, None)]
    keys = [(i, f"small ring {i}") for i in range(n)] + [(n, f"{tail} other"), (n + 1, f"{tail} missing"), (n + 2, tail), (n + 3, "-")]
    t, k = spark.createDataFrame(texts, "qid long, text string"), spark.createDataFrame(keys, "pos long, key string")
    want = {(i, j) for i in range(n) for j in (i, i + 7) if j < n} | {(n, n), (n, n + 2), (n + 1, n + 2)}
    got = [(r.qid, r.pos) for r in ky.key_matches(t, k, carry=("pos",)).collect()]
    assert set(got) == want and len(got) == len(want)
    # Before anything is dropped, the texts have met no key but their own.
    met = ky._met(t.select("qid", words(F.col("text")).alias("_w")), k.filter(F.col("pos") < n).select(words(F.col("key")).alias("_k")))
    assert met.count() == 2 * n - 7


def _small_files_of_many_keys(spark, path):
    """Texts and keys whose files are far smaller than what is made of them, as (texts, keys)."""
    rows = spark.range(3000).select("id", F.concat(F.lit("small ring "), F.col("id").cast("string")).alias("s"))
    rows.select(F.col("id").alias("qid"), F.concat("s", F.lit("!")).alias("text")).write.parquet(f"{path}/texts")
    rows.select(F.col("id").alias("pos"), F.col("s").alias("key")).write.parquet(f"{path}/keys")
    return spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/keys")


def test_alias_tables_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    from pandekt.operators import keys as ky

    t, k = _small_files_of_many_keys(spark, str(tmp_path))
    got = ky.expand_terms_by(t, k.select(F.col("pos").alias("alias_pos"), "key", F.array(F.concat(F.lit("form of "), "key")).alias("forms")))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter(F.col("expanded") == F.concat(F.lit("small ring "), F.col("qid"), F.lit("! form of small ring "), F.col("qid"))).count() == 3000


def test_name_tables_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    from pandekt.operators import keys as ky

    t, k = _small_files_of_many_keys(spark, str(tmp_path))
    got = ky.detect_entities_by(t, k.select(F.col("pos").alias("entity_pos"), F.col("pos").alias("entity"), F.col("key").alias("name")))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter(F.col("entities") == F.array("qid")).count() == 3000


def test_respond_from_question_to_verified_answer(spark, corpus):
    from pandekt.operators.answers import respond

    _, c = corpus
    q = spark.createDataFrame([("Q1", "GDPR e AI Act: norma ente"), ("Q2", "GDPR norma ente")], "qid string, text string")
    g = spark.createDataFrame([("gdpr", "d1"), ("ai_act", "d2")], "norm_id string, doc_urn string")
    sub = spark.createDataFrame([("Q1", "gdpr", "norma"), ("Q1", "ai_act", "ente")], "qid string, norm_id string, text string")
    rec = spark.createDataFrame([("Q1", "Vedi [cite:mai].", 5.0)], "qid string, text string, generate_ms double")

    def live(batches):
        for pdf in batches:
            yield pdf.assign(text="Nulla.", generate_ms=7.0)[["qid", "text", "generate_ms"]]

    times = spark.createDataFrame([("Q1", 1.0, 2.0)], "qid string, retrieval_ms double, verify_ms double")
    c = c.withColumn("hierarchy_path", F.array("doc_urn"))
    got = {r.qid: r for r in respond(q, c, g, sub, rec, live, times=times, mode="sparse").collect()}
    assert (got["Q1"].n_total, got["Q1"].n_verified, got["Q2"].answer) == (1, 0, "Nulla.")
    assert got["Q1"].timings_ms == {"retrieval_ms": 1.0, "generate_ms": 5.0, "verify_ms": 2.0, "total_ms": 8.0}
    assert got["Q2"].timings_ms == {"retrieval_ms": None, "generate_ms": 7.0, "verify_ms": None, "total_ms": 7.0} and got["Q1"].n_hits > 0


def test_questions_are_sent_once_per_block(spark, monkeypatch):
    """Vectors without any groups: every question may need every chunk, and still moves once per block of them."""
    from pandekt.operators import dense

    v = np.random.default_rng(4).normal(size=(600, 16))
    e = spark.createDataFrame(pd.DataFrame({"qid": np.arange(600), "vec": v.tolist()}))
    c = e.withColumnRenamed("qid", "chunk_id")
    sent = []
    monkeypatch.setattr(dense, "_compared", lambda qs, cs, *a, f=dense._compared: sent.append((qs.count(), cs.count())) or f(qs, cs, *a))
    want = rows(dense_topk(e, c, 5, skip_same_id=True))
    assert sent == [] and want == rows(dense_topk(e, c, 5, skip_same_id=True, block_rows=25))
    # Blocks of 106 rows: 8 of chunks, 6 of questions in each visit; 24 cells before.
    assert sum(n for n, _ in sent) <= 600 * 9 and sum(n for _, n in sent) <= 2 * 600 * 6


def test_equal_questions_are_searched_once(spark, monkeypatch):
    from pandekt.operators import dense

    q = spark.range(3000).select(F.col("id").alias("qid"), F.array((F.col("id") % 9).cast("double"), (F.col("id") % 7 - 3).cast("double")).alias("vec"))
    c = spark.range(200).select(F.col("id").alias("chunk_id"), F.array((F.col("id") % 5).cast("double"), (F.col("id") % 11 - 5).cast("double")).alias("vec"))
    want = rows(dense_topk(q, c, 4))
    seen = []
    monkeypatch.setattr(dense, "_visited", lambda q, *a, f=dense._visited: seen.append(q.count()) or f(q, *a))
    assert len(want) == 12000 and want == rows(dense_topk(q, c, 4, block_rows=40)) and seen == [63]
    assert want == rows(dense_topk(q, c, 4, block_rows=70)) and seen == [63]


def test_words_are_counted_in_runs():
    import pyarrow as pa

    from pandekt.operators.embedding import word_runs

    lists = pa.array([["a"] * 3, None, [], ["b"] * 9, ["c"] * 2, ["d"] * 2], pa.list_(pa.string()))
    assert list(word_runs(lists, 5)) == [(0, 3), (3, 4), (4, 6)]
    assert list(word_runs(lists.slice(3), 5, rows=1)) == [(0, 1), (1, 2), (2, 3)]
    assert list(word_runs(lists.slice(6), 5)) == []


def test_live_index_reads_tombstones_of_asked_chunks_only(spark, tmp_path):
    from pandekt.operators.live_index import LiveIndex

    batch = spark.createDataFrame([(f"c{i}", "d", f"parola{i}") for i in range(6)], "chunk_id string, doc_urn string, text string")
    index = LiveIndex(spark, str(tmp_path / "live")).upsert(batch, 0).upsert(batch.filter("chunk_id = 'c1'"), 1)
    asked = batch.filter("chunk_id in ('c1', 'c2')").select("chunk_id")
    assert rows(index._alive(asked).select("chunk_id")) == [("c1",), ("c2",)] and index._alive().count() == 6
    plan = index._alive(asked)._jdf.queryExecution().optimizedPlan().toString()
    # The outer join is the one with the tombstones.
    assert plan.index("LeftAnti") < plan.index("LeftSemi")


def test_live_index_moves_words_once(spark, tmp_path):
    """Shuffled bytes of a batch and of the removal of a few of its chunks, when nothing is small enough to be broadcast unasked."""
    from pandekt.operators.live_index import LiveIndex

    def shuffled():
        tracker, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
        bus.waitUntilEmpty(30_000)
        stages = tracker.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    rng = np.random.default_rng(8)
    batch = spark.createDataFrame([(f"c{i}", "d", " ".join(f"w{x}" for x in rng.integers(0, 50, 2000))) for i in range(400)], "chunk_id string, doc_urn string, text string").repartition(4)
    batch = cut_lineage(batch)
    before, limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")
    try:
        start = shuffled()
        batch.dropDuplicates(["chunk_id"]).write.parquet(str(tmp_path / "once"))
        once, start = shuffled() - start, shuffled()
        index = LiveIndex(spark, str(tmp_path / "live")).upsert(batch, 0)
        added, start = shuffled() - start, shuffled()
        index = index.upsert(batch.limit(3).withColumn("text", F.lit(None).cast("string")), 1)
        removed = shuffled() - start
    finally:
        spark.conf.set(limit, before)
    assert added < 1.5 * once and removed < 0.25 * once
    assert index._alive().count() == 397 and index.stats().first().n_docs == 397


def test_blocks_of_places_in_any_order_and_size(spark, corpus, tmp_path, monkeypatch):
    """Shards in pieces, words and places too many to be sent with tasks, empty batches and batches of removals, folded at the end."""
    from pandekt.functions.text import words
    from pandekt.operators import live_index, postings

    q, c = corpus
    rows_of = c.select(F.col("chunk_id").alias("id"), F.col("doc_urn").alias("urn"), words(F.col("text")).alias("w"))
    placed = cut_lineage(postings.placed(rows_of, 50))
    blocks = cut_lineage(postings.blocks_of_places(placed.repartition(5)))
    assert blocks.filter("term = ''").count() == placed.select("shard").distinct().count()
    whole = cut_lineage(posting_blocks(c, shard_rows=50))
    assert rows(postings.block_frequencies(blocks)) == rows(postings.block_frequencies(whole)) and rows(postings.block_stats(blocks)) == rows(postings.block_stats(whole))
    for want in (None, "want"):
        assert rows(sparse_topk(q, c, 7, filter_doc=want, postings=blocks)) == rows(sparse_topk(q, c, 7, filter_doc=want))
    for sent in (0, 1 << 17):
        monkeypatch.setattr(postings, "SENT_WORDS", sent)
        monkeypatch.setattr(live_index, "SENT_PLACES", sent)
        index = live_index.LiveIndex(spark, str(tmp_path / f"live{sent}")).upsert(c.limit(0), 0).upsert(c, 1, shard_rows=50)
        gone = c.filter("doc_urn = 'd1'").select("chunk_id", "doc_urn", F.lit(None).cast("string").alias("text"))
        index = index.upsert(gone, 2).upsert(c.filter("chunk_id = 'd0__art_0'"), 3)
        for now in (index, index.fold(40)):
            assert rows(now.search(q, 7, "want")) == rows(sparse_topk(q, c.filter("doc_urn <> 'd1'"), 7, filter_doc="want"))
