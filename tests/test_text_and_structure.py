import uuid

import numpy as np
import pytest

from pyspark.sql import functions as F

from pandekt.functions import ids, text as tx
from pandekt.operators import chunking as ch
from pandekt.operators import structure as st
from pandekt.operators.ordered import carry_forward, row_positions, running_sum
from pandekt.operators.packing import FOLD_RUN, group_starts, pack_greedy
from tests.conftest import rows


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


def test_point_id_equals_uuid5(spark):
    for s in ("eli/reg/2016/679/oj__art_35", "città è", "", "x" * 300):
        assert one(spark, s, ids.point_id) == str(uuid.uuid5(uuid.NAMESPACE_OID, s))
    assert one(spark, "eli/reg/2016/679/oj__art_35", ids.point_id) == "5c5fb7c7-bc12-5072-9006-616b5050df74"


def test_text_helpers(spark):
    assert one(spark, " a  b\t\nc ", tx.collapse_ws) == "a b c"
    assert one(spark, "(( (Oggetto). ))", tx.clean_heading) == "Oggetto"
    assert one(spark, "(Base giuridica)", tx.clean_heading) == "Base giuridica"
    assert one(spark, "alpha beta gamma", lambda c: tx.cut_at_word(c, 12)) == "alpha beta"
    assert one(spark, "x" * 70, lambda c: tx.cut_at_word(c, 60)) == "x" * 60
    assert one(spark, "MCMXCIV", tx.roman_to_int) == 1994 and one(spark, "XIII", tx.roman_to_int) == 13 and one(spark, "XA", tx.roman_to_int) is None
    assert str(one(spark, "2003-06-30", tx.iso_date)) == "2003-06-30"
    assert one(spark, "2003-06", tx.iso_date) is None and one(spark, "2003-13-01", tx.iso_date) is None
    assert one(spark, "", tx.count_tokens) == 0 and one(spark, None, tx.count_tokens) == 0 and one(spark, "È l'art. 5", tx.count_tokens) == 6
    assert one(spark, "aaaa", lambda c: tx.count_occurrences(c, F.lit("aa"))) == 2


def test_article_order(spark):
    df = spark.createDataFrame([("art_25",), ("art_24-ter",), ("art_3",), ("art_24",), ("art_24-bis",), ("art_x",)], "e string")
    got = [r[0] for r in df.orderBy(tx.article_sort_key(F.col("e"))).collect()]
    assert got == ["art_3", "art_24", "art_24-bis", "art_24-ter", "art_25", "art_x"]


def test_ids(spark):
    assert one(spark, "32016R0679", ids.celex_doc_urn) == "eli/reg/2016/679/oj"
    assert one(spark, "32016X0012", ids.celex_doc_urn) == "eli/x/2016/12/oj" and one(spark, "foo", ids.celex_doc_urn) == "celex/foo"
    number = lambda raw, eid: one(spark, raw, lambda c: ids.article_number(c, F.lit(eid)))
    assert number("Art. 2-bis.", "e") == "2-bis" and number(" 7. ", "e") == "7" and number("", "art_9") == "9" and number(None, "x") == "x"


def test_pack_example(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([900, 800, 500, 2500, 100])], "a int, i int, t int")
    assert [(r.i, r.group_index) for r in pack_greedy(df, ["a"], ["i"], "t").orderBy("i").collect()] == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)]


def test_pack_blocks_equal_arrays(spark):
    data = spark.range(4000).select((F.col("id") % 3).alias("a"), F.col("id").alias("i"), (F.abs(F.hash("id")) % 60 * F.when(F.col("id") % 97 == 0, 9).otherwise(1)).cast("int").alias("t"))
    whole = rows(pack_greedy(data, ["a"], ["i"], "t", 200))
    for block in (37, 400):
        assert rows(pack_greedy(data, ["a"], ["i"], "t", 200, max_article=500, block_rows=block)) == whole
    mixed = data.unionByName(spark.createDataFrame([(9, 1, 5), (9, 2, 7)], data.schema))
    assert rows(pack_greedy(mixed, ["a"], ["i"], "t", 200, max_article=500, block_rows=333)) == sorted(whole + [(9, 1, 5, 0), (9, 2, 7, 0)], key=repr)


def test_hot_groups_equal_windows(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"), F.col("id").alias("o"),
                                 F.when(F.hash("id") % 7 == 0, F.col("id").cast("string")).alias("v"), (F.col("id") % 11).alias("n"))
    hot = dict(max_group=200, block_rows=100)
    assert rows(row_positions(d, ["g"], ["o"])) == rows(row_positions(d, ["g"], ["o"], **hot))
    assert rows(running_sum(d, ["g"], ["o"], "n", "s")) == rows(running_sum(d, ["g"], ["o"], "n", "s", **hot))
    assert rows(carry_forward(d, ["g"], ["o"], {"v": "c"})) == rows(carry_forward(d, ["g"], ["o"], {"v": "c"}, **hot))
    assert rows(row_positions(d, [], ["o"])) == rows(row_positions(d, [], ["o"], **hot))


def test_sums_of_fractions_do_not_depend_on_blocks(spark):
    d = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("o"), (F.col("id") * 0.1 + 0.7).alias("n"))
    assert rows(running_sum(d, ["g"], ["o"], "n", "s")) == rows(running_sum(d, ["g"], ["o"], "n", "s", max_group=50, block_rows=30))


def test_packing_rejects_fractions(spark):
    d = spark.range(10).select(F.lit(1).alias("a"), F.col("id").alias("i"), F.lit(0.1).alias("t"))
    with pytest.raises(Exception, match="whole numbers"):
        pack_greedy(d, ["a"], ["i"], "t", 1).collect()
    whole = d.withColumn("t", F.lit(1.0))
    assert rows(pack_greedy(whole, ["a"], ["i"], "t", 3)) == rows(pack_greedy(whole, ["a"], ["i"], "t", 3, max_article=2, block_rows=3))


def test_partition_count_does_not_matter(spark):
    d = spark.range(500).select((F.col("id") % 7).alias("a"), F.col("id").alias("i"), (F.col("id") % 13).cast("int").alias("t"))
    assert rows(pack_greedy(d.repartition(1), ["a"], ["i"], "t", 30)) == rows(pack_greedy(d.repartition(17), ["a"], ["i"], "t", 30))


def test_hierarchy(spark):
    data = [("d", 0, "TITOLO I", None), ("d", 1, "Capo I", "Principi SEZIONE IV generali"), ("d", 2, "SEZIONE II", None), ("d", 3, None, None),
            ("d", 4, "Capo II", "x"), ("d", 5, "Titolo II", None), ("d", 6, "Parte", None)]
    out = st.carry_hierarchy(spark.createDataFrame(data, "doc_urn string, pos int, number string, title string")).orderBy("pos").collect()
    assert [(r.titolo, r.capo, r.sezione) for r in out] == [
        ("Titolo I", None, None), ("Titolo I", "Capo I", "Sezione IV"), ("Titolo I", "Capo I", "Sezione II"), ("Titolo I", "Capo I", "Sezione II"),
        ("Titolo I", "Capo II", None), ("Titolo II", "Capo II", None), ("Titolo II", "Capo II", None)]


def test_line_segmenter(spark):
    text = ("## Titolo I\nperso\n### Art. 1 - (Oggetto).\nprima\n1. uno\n\nancora\n((2. due\n### Art. 2-bis.\n1-bis. tre\nAGGIORNAMENTO (3)\nnota\n\n1. dentro nota\n"
            "## Titolo II\n1. fuori\n### Art. 3\nsolo testo")
    out = st.line_segmenter(spark.createDataFrame([(1, text)], "id int, text string"))
    assert [(r.section, r.header, r.kind, r.unit_text) for r in out.orderBy("article_pos", F.desc("kind"), "unit_pos").collect()] == [
        ("## Titolo I", "### Art. 1 - (Oggetto).", "paragraph", "1. uno\n\nancora"), ("## Titolo I", "### Art. 1 - (Oggetto).", "paragraph", "((2. due"),
        ("## Titolo I", "### Art. 2-bis.", "paragraph", "1-bis. tre"), ("## Titolo I", "### Art. 2-bis.", "note", "AGGIORNAMENTO (3) nota 1. dentro nota")]


def test_repeal(spark):
    d = spark.createDataFrame([("ARTICOLO ABROGATO", "x", "x"), ("Oggetto", " ((ARTICOLO ABROGATO dal", "y"), ("Oggetto", "testo", "il comma (PERIODO abrogato)"),
                               ("articolo abrogato", "testo", "z"), (None, None, "t")], "h string, p string, b string")
    got = [r[0] for r in d.select(st.repeal_class(F.col("h"), F.col("p"), F.col("b"))).collect()]
    assert got == ["repealed", "repealed", "residual", "active", "active"]


def article(eid, paras, number="1"):
    return ("eli/x", eid, number, "Oggetto", ["Capo I"], paras)


SCHEMA = ("doc_urn string, article_eid string, number string, rubrica string, hierarchy_path array<string>, "
          "paragraphs array<struct<eid:string,number:string,text:string>>")


def test_chunks(spark):
    long = "parola " * 30
    df = spark.createDataFrame([
        article("art_1", [("p1", "1", "breve"), ("p2", "2", "2. già numerato")]),
        article("art_2", [("p1", "1", long), ("p2", "2", long), ("p3", "3", "fine")]),
        article("art_3", [("b", None, long * 3)]), article("art_4", [])], SCHEMA)
    out = {r.chunk_id: r for r in ch.build_chunks(df, threshold=50).collect()}
    assert sorted(out) == ["eli/x__art_1", "eli/x__art_2__paras_1_1", "eli/x__art_2__paras_2_3", "eli/x__art_3", "eli/x__art_4"]
    assert out["eli/x__art_1"].text == "Articolo 1 - Oggetto\n\n1. breve\n\n2. già numerato"
    group = out["eli/x__art_2__paras_2_3"]
    assert group.para_eids == ["p2", "p3"] and group.metadata.group_index == 1 and group.metadata.group_count == 2 and group.chunk_type == "article_group"
    assert out["eli/x__art_3"].metadata.oversize is True and out["eli/x__art_1"].metadata.oversize is None
    assert all(r.n == 0 for r in ch.chunk_invariants(ch.build_chunks(df, threshold=50), df).collect())
    assert any(r.n > 0 for r in ch.chunk_invariants(ch.build_chunks(df, threshold=50).filter("article_eid != 'art_1'"), df).collect())


def test_group_starts_at_the_ends_of_runs(spark):
    rng = np.random.default_rng(4)
    cases = [[], [5], [3000], *[rng.integers(0, 900, n).tolist() for n in (FOLD_RUN - 1, FOLD_RUN, FOLD_RUN + 1)], rng.integers(0, 3000, 5 * FOLD_RUN + 7).tolist()]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t array<int>")
    for row in df.select("i", "t", group_starts(F.col("t"), 2000).alias("starts")).collect():
        want, held = [], 0
        for i, x in enumerate(row.t):
            if i == 0 or held + x > 2000:
                want.append(i)
                held = 0
            held += x
        assert row.starts == want


def test_chunk_rules_count_tokens_once(spark):
    from pandekt.plans import load_all

    df = load_all()[0]["b14_chunk_invariants"](spark, "/root/testdata/sf0.001")
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.n for r in df.collect()) == [0] * 5
