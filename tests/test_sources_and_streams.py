import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pandekt.operators import answers as an
from pandekt.session import scratch_path
from pandekt.sources import index as ix
from pandekt.sources import manifest as mf
from pandekt.sources import markup as mk
from pandekt.streaming import jobs
from tests.conftest import rows

AKN = """<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><body>%s</body></act></akomaNtoso>"""
ART = ('<article eId="art_%s"><num>Art. %s.</num><heading>Og&lt;getto</heading><paragraph eId="p1"><num>1.</num><content><p>Testo <ref href="a">uno</ref> &amp; a &lt; b</p></content></paragraph>'
       '<paragraph><content><p>((</p></content></paragraph></article>')


def test_xml(spark):
    docs = [(1, AKN % ('<chapter eId="c1"><num>Capo I</num><heading>Prin<i>ci</i>pi</heading>' + ART % ("1", "1") + "</chapter><chapter eId='c2'><num>Capo II</num>" + ART % ("2-bis", "2-bis") + "</chapter>")),
            (2, AKN % (ART % ("7", "7")))]
    out = [(r.id, r.chapter_eid, r.chapter_number, r.chapter_title, r.article_eid, r.article_number, r.rubrica, r.para_number, r.para_text)
           for r in mk.xml_sections(spark.createDataFrame(docs, "id int, xml string"), "xml", ["id"]).orderBy("id", "chapter_pos").collect()]
    text = "1.Testo uno & a < b"
    assert out == [(1, "c1", "Capo I", "Principi", "art_1", "1", "Og<getto", "1", text), (1, "c2", "Capo II", None, "art_2-bis", "2-bis", "Og<getto", "1", text),
                   (2, "", None, None, "art_7", "7", "Og<getto", "1", text)]


def test_html_sections(spark):
    html = ('<html><body><p>prima<div id="art_1"><h2>Articolo 1</h2><p>1. Uno <span class="footnote">nota</span>coda</p><p>senza numero</p><p>2.\xa0Due</p></div>'
            '<div id="art_2"><h2>Articolo 2</h2><p>corpo a<p>corpo b<script>x<p>y</script></div></body></html>')
    out = [(r.section_id, r.heading, r.number, r.text) for r in mk.html_sections(spark.createDataFrame([(1, html)], "id int, h string"), "id", "h").orderBy("section_pos", "para_pos").collect()]
    assert out == [("", "", None, "prima"), ("art_1", "Articolo 1", "1", "Uno coda"), ("art_1", "Articolo 1", "2", "Due"), ("art_2", "Articolo 2", None, "corpo a\n\ncorpo b")]


def test_nested_points(spark):
    html = "<ul><li>Primo punto: molto lungo<ul><li>a) uno</li><li>b) due</li></ul></li><li>Secondo</li></ul><p>x</p><ol><li>Altro</li></ol>"
    out = rows(mk.nested_points(spark.createDataFrame([(1, html)], "id int, h string"), "id", "h"))
    assert out == [(1, 0, 1, 2, "Primo punto: molto lungo\n    a) uno\n    b) due", "Primo punto"), (1, 0, 2, 0, "Secondo", "Secondo"), (1, 1, 1, 0, "Altro", "Altro")]


def test_html_article_parts(spark):
    """A title inside its own element, a marker line, a list under a number, chapters."""
    html = ('<div id="cpt_II"><p class="title-division-1">CAPO II</p><p class="title-division-2">Titolo del capo</p><div id="art_4"><p class="oj-ti-art">Articolo 4-bis</p>'
            '<div class="eli-title"><p class="oj-sti-art">Oggetto</p></div><div><p class="oj-normal">1.\xa0stabilisce:</p><table><tr><td>a)</td><td>prima regola</td></tr></table></div>'
            '<p class="modref">2. no</p><div>2. Altro <span class="footnote">x</span>testo</div></div></div>')
    out = [(r.marker, r.heading, r.chapter_id, r.chapter_title, r.number, r.text) for r in mk.html_sections(spark.createDataFrame([(1, html)], "id int, h string"), "id", "h").orderBy("para_pos").collect()]
    head = ("4-bis", "Oggetto", "cpt_II", "Titolo del capo")
    assert out == [(*head, "1", "stabilisce:a)prima regola"), (*head, "2", "Altro testo")]


def test_unclosed_lists_and_tables(spark):
    html = "<ul><li>Uno<li>Due<p>coda<script>no()</script></ul>fuori<table><tr><td>1.<td>Punto<table><tr><td>a)<td>uno</table></table>"
    out = rows(mk.nested_points(spark.createDataFrame([(1, html)], "id int, h string"), "id", "h").drop("title"))
    assert out == [(1, 0, 1, 0, "Uno"), (1, 0, 2, 0, "Duecoda"), (1, 1, 1, 1, "1. Punto\n    a) uno")]


def test_html_text_keeps_what_is_no_noise(spark):
    d = spark.createDataFrame([('<div class="ad"><p>x</p> pubblicita</div>a<p class="ad big">y</p>b<p class="advice">c</p>',)], "h string")
    assert d.select(mk.html_text(F.col("h"), noise_classes=("ad",))).first()[0] == "abc"


def test_html_text(spark):
    d = spark.createDataFrame([('a<script>x</script>b <div class="ad">no</div>c&nbsp;d &amp;lt; <!-- z -->e',)], "h string")
    assert d.select(mk.html_text(F.col("h"), noise_classes=("ad",))).first()[0] == "ab c d &lt; e"


def test_html_text_joins_words_and_drops_nested_noise(spark):
    cases = [('<p>re<i>cital</i></p><div class="ad">x<div>y</div>leak</div>', "recital"), ('a<div class="b ad c">x<p class="ad">y</p><br>z</div> tail', "a tail"), (None, None), ("", ""),
             ("<div class='ad'>never closed", ""), ("x &amp; y<img src=a>z</b>", "x & yz"), ('<div class="added">kept</div>', "kept"), ("<ul><li class=ad>one<li>two</ul>", "two")]
    d = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string")
    assert [r[0] for r in d.orderBy("i").select(mk.html_text(F.col("h"), noise_classes=("ad",))).collect()] == [t for _, t in cases]


def test_content_gate(spark):
    body = "<!DOCTYPE html>" + "x" * 10_000
    cases = [("text/html", "", "too_small"), ("text/html", "<html>", "too_small"), (None, "x" * 10_001, "not_html"), ("text/html; charset=utf-8", "  \n" + body, None),
             (None, body, None), ("application/xml", body, "content_type"), ("", "<HTML>" + "x" * 10_000, None)]
    d = spark.createDataFrame([(a, b) for a, b, _ in cases], "t string, h string")
    assert [r.reject_reason for r in mf.content_gate(d, "t", "h").collect()] == [c for _, _, c in cases]


def test_links_and_lookup(spark):
    d = spark.createDataFrame([('<a href="/do?a=1&amp;b=2">',), ('<a href="http://x/y">',), ("none",)], "h string")
    assert [r[0] for r in d.select(mf.extract_link(F.col("h"), 'href="([^"]+)"', "https://n.it")).collect()] == ["https://n.it/do?a=1&b=2", "http://x/y", None]
    t = spark.createDataFrame([("a", "A")], "id string, text string")
    want = spark.createDataFrame([("a",), ("z",)], "id string")
    assert rows(mf.lookup_by_id(want, t, "id")) == [("a", "A"), ("z", "")]
    with pytest.raises(KeyError, match="z"):
        mf.lookup_strict(want, t, "id")


def test_read_binary(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(b"<x/>")
    (tmp_path / "b.txt").write_bytes(b"no")
    assert [(bytes(r.raw), r.size) for r in mf.read_binary(spark, str(tmp_path), "*.xml").collect()] == [(b"<x/>", 4)]


CHUNKS = "chunk_id string, text string, version int, doc_urn string"


def test_upsert_table(spark):
    path = scratch_path(spark, "index")
    make = lambda *r: ix.with_point_id(spark.createDataFrame(list(r), CHUNKS)).select("point_id", "chunk_id", "text", "version", "doc_urn")
    read = lambda: [(r.chunk_id, r.text) for r in ix.read_index(spark, path).orderBy("chunk_id").collect()]
    first = make(("a__1", "x", 1, "a"), ("a__2", "y", 1, "a"), ("b__1", "z", 1, "b"))
    for _ in range(2):
        assert ix.upsert_index(spark, path, first) == 3
        assert read() == [("a__1", "x"), ("a__2", "y"), ("b__1", "z")]
    assert ix.upsert_index(spark, path, make(("a__1", "old", 2, "a"), ("a__1", "new", 3, "a"), ("c__1", "w", 1, "c")), order=["version"]) == 2
    assert read() == [("a__1", "new"), ("a__2", "y"), ("b__1", "z"), ("c__1", "w")]
    ix.upsert_index(spark, path, first, "reset")
    assert read() == [("a__1", "x"), ("a__2", "y"), ("b__1", "z")]
    with pytest.raises(ValueError):
        ix.upsert_index(spark, path, first, "other")


def test_readers_see_whole_versions_only(spark, monkeypatch):
    """A pinned reader, a crash before the head is in place, two writers from one version, dropping old versions."""
    from pandekt.sources import versions

    path = scratch_path(spark, "index")
    make = lambda *r: ix.with_point_id(spark.createDataFrame(list(r), CHUNKS)).select("point_id", "chunk_id", "text", "version", "doc_urn")
    texts = lambda df: sorted((r.chunk_id, r.text) for r in df.collect())
    ix.upsert_index(spark, path, make(("a__1", "x", 1, "a"), ("b__1", "y", 1, "b/2 =")))
    pinned = ix.read_index(spark, path)
    ix.upsert_index(spark, path, make(("a__1", "x2", 2, "a")))
    assert texts(pinned) == [("a__1", "x"), ("b__1", "y")] and texts(ix.read_index(spark, path)) == [("a__1", "x2"), ("b__1", "y")]

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", crash)
        with pytest.raises(OSError):
            ix.upsert_index(spark, path, make(("a__1", "x3", 3, "a"), ("c__1", "z", 1, "c")))
        nested = scratch_path(spark, "nested")
        with pytest.raises(OSError):
            ix.write_nested(ix.nest_results(spark.createDataFrame([("q", 1, "a", 0.5)], "qid string, rank bigint, chunk_id string, score double")), nested)
        with pytest.raises(FileNotFoundError):
            ix.read_nested(spark, nested)
    assert texts(ix.read_index(spark, path)) == [("a__1", "x2"), ("b__1", "y")]
    with monkeypatch.context() as m:
        real = versions.head
        m.setattr(versions, "head", lambda s, p, v=None: real(s, p, 1 if v is None else v))  # a writer that started from version 1
        with pytest.raises(versions.VersionTaken):
            ix.upsert_index(spark, path, make(("a__1", "late", 9, "a")))
    assert texts(ix.read_index(spark, path)) == [("a__1", "x2"), ("b__1", "y")] and texts(ix.read_index(spark, path, 1)) == [("a__1", "x"), ("b__1", "y")]
    assert versions.vacuum(spark, path, keep=1) == 2 and versions.versions(spark, path) == [2]
    assert texts(ix.read_index(spark, path)) == [("a__1", "x2"), ("b__1", "y")]


def test_nested_results(spark):
    hits = spark.createDataFrame([("q", 2, "b", 0.5), ("q", 1, "a", 0.7)], "qid string, rank bigint, chunk_id string, score double")
    path = scratch_path(spark, "nested")
    for _ in range(2):
        ix.write_nested(ix.nest_results(hits), path)
        assert rows(ix.read_nested(spark, path)) == [("q", 1, "a", 0.7), ("q", 2, "b", 0.5)]


def test_nesting_keeps_every_hit(spark):
    hits = spark.range(70).select(F.lit("q").alias("qid"), (F.col("id") + 1).alias("rank"), F.col("id").cast("string").alias("chunk_id"), F.lit(0.5).alias("score"))
    assert len(ix.nest_results(hits).first().top) == 70
    assert len(ix.nest_results(hits, depth=3).first().top) == 3


def check(spark, text, context):
    return an.verify_citations(spark.createDataFrame([(text, context)], "answer string, context array<string>")).first()


def test_citations(spark):
    r = check(spark, "Prima [cite:gdpr/art_35], poi [cite:foo/bar], infine [cite:aiact/art_27].", ["gdpr/art_35", "aiact/art_27"])
    assert (r.n_total, r.n_verified, r.n_unverified, r.all_verified) == (3, 2, 1, False)
    assert r.annotated == "Prima [cite:gdpr/art_35], poi [cite:foo/bar NON VERIFICATA], infine [cite:aiact/art_27]."
    assert [m.reason for m in r.markers] == ["ok", "unknown_chunk_id", "ok"]
    for text in ("", "vuoto [cite:] e [cite: foo]"):
        r = check(spark, text, [])
        assert r.n_total == 0 and r.all_verified and r.annotated == text
    r = check(spark, "ab [cite:x] cd😀 [cite:y/z], e [cite:bad id]", None)
    assert [(m.span_start, m.span_end) for m in r.markers] == [(3, 11), (16, 26)]


def test_prompt(spark):
    q = spark.createDataFrame([("q", " Che cosa? "), ("z", "Niente")], "qid string, text string")
    hits = spark.createDataFrame([("q", 2, "b"), ("q", 1, "a")], "qid string, rank bigint, chunk_id string")
    chunks = spark.createDataFrame([("a", " A ", ["T", "art. 1"]), ("b", "B", None)], "chunk_id string, text string, hierarchy_path array<string>")
    exp = spark.createDataFrame([("q", "e", "attua", "nota", 1)], "qid string, chunk_id string, relation string, note string, source_rank int")
    p = {r.qid: r.prompt for r in an.context_prompt(q, hits, chunks, exp).collect()}
    assert p["q"] == ("Domanda: Che cosa?\n\nContesto normativo (2 riferimenti):\n\n[chunk_id: a]\nT > art. 1\n---\nA\n===\n\n[chunk_id: b]\n---\nB\n===\n\n"
                      "Riferimenti correlati (graph espansione):\n- [chunk_id: e]: attua — nota\n\n" + an.CLOSING_LINE)
    assert p["z"] == f"Domanda: Niente\n\nContesto normativo (0 riferimenti):\n\n{an.NO_CONTEXT_LINE}\n\n{an.CLOSING_LINE}"


def test_delta_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda ms: t0 + dt.timedelta(milliseconds=ms)
    schema = "request_id string, seq int, text string, is_final boolean, ts timestamp"
    batches = [
        [("a", 0, "", False, at(0)), ("a", 2, "do", False, at(30)), ("b", 0, "x", False, at(0))],
        [("a", 1, "mon", False, at(20)), ("a", 1, "mon", False, at(20)), ("a", 3, "", True, at(50)), ("c", 0, "", True, at(5))],
        [("d", 0, "tardi", True, at(3_600_000 * 5))]]
    src = tmp_path / "in"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(src / f"part{i}"))
    files = sorted(src.glob("part*/*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    import os
    for i, f in enumerate(files):
        target = flat / f"{i}.parquet"
        target.write_bytes(f.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = jobs.table_stream(spark, str(flat), "*.parquet", files_per_trigger=1)
    out = str(tmp_path / "out")
    jobs.run_available(jobs.assemble_deltas(stream), out, str(tmp_path / "ck"))
    got = {r.request_id: r for r in spark.read.parquet(out).collect()}
    assert (got["a"].text, got["a"].n_deltas, got["a"].ttft_ms, got["a"].total_ms, got["a"].complete) == ("mondo", 4, 20.0, 50.0, True)
    assert got["c"].text == "" and got["c"].ttft_ms == 0 and got["d"].complete
    assert got["b"].text == "x" and got["b"].complete is False
    twin = {r.request_id: tuple(r) for r in jobs.assemble_deltas_batch(spark.read.parquet(str(flat))).collect()}
    assert twin == {k: tuple(v) for k, v in got.items()}


def test_a_streamed_table_is_a_file_or_a_folder_of_files(spark, tmp_path):
    """Beside other tables, in either form, every row of the named table and no other arrives once."""
    for name, parts in (("one", 3), ("other", 2)):
        spark.range(60).withColumn("t", F.lit(name)).repartition(parts).write.parquet(str(tmp_path / f"{name}.parquet"))
    whole = spark.range(60).withColumn("t", F.lit("file")).coalesce(1)
    whole.write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "file.parquet")
    for name in ("one", "file"):
        out = str(tmp_path / f"out-{name}")
        jobs.run_available(jobs.table_stream(spark, str(tmp_path), f"{name}.parquet"), out, str(tmp_path / f"ck-{name}"))
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(i, name) for i in range(60)]


def test_answers_go_on_after_a_restart(spark, tmp_path):
    """A run ends in the middle of an answer; the next one, from its checkpoint, completes it. Deltas come backwards and twice."""
    t0 = dt.datetime(2026, 1, 1)
    rows = [("long", i, f"{i} ", i == 2_999, t0 + dt.timedelta(milliseconds=i)) for i in range(3_000)]
    schema = "request_id string, seq bigint, text string, is_final boolean, ts timestamp"
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    add = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    add(rows[2_000:][::-1])
    jobs.run_available(jobs.assemble_deltas(jobs.table_stream(spark, str(src), "*.parquet")), out, ck)
    assert spark.read.schema(jobs.ANSWER_SCHEMA).parquet(out).count() == 0
    add(rows[:2_100] + [("short", 0, "x", False, t0)])
    jobs.run_available(jobs.assemble_deltas(jobs.table_stream(spark, str(src), "*.parquet")), out, ck)
    got = spark.read.parquet(out).collect()
    assert [(r.request_id, r.n_deltas, r.total_ms, r.complete) for r in got] == [("long", 3_000, 2_999.0, True)]
    assert got[0].text == "".join(r[2] for r in rows)
    # Time passes for another request: the unfinished one is given up.
    add([("later", 0, "y", True, t0 + dt.timedelta(hours=2))])
    jobs.run_available(jobs.assemble_deltas(jobs.table_stream(spark, str(src), "*.parquet")), out, ck)
    assert {(r.request_id, r.complete) for r in spark.read.parquet(out).collect()} == {("long", True), ("later", True), ("short", False)}


def test_live_index_equals_one_built_anew(spark, tmp_path):
    """After every batch: replaced, added, removed and repeated chunks, a replayed batch, folding in between, a stream on top."""
    import random

    from pandekt.operators.live_index import LiveIndex
    from pandekt.operators.sparse import sparse_topk

    rng = random.Random(6)
    draw = lambda: " ".join(rng.choices([f"w{i}" for i in range(30)], k=rng.randint(1, 25)))
    schema = "chunk_id string, doc_urn string, text string, version int"
    q = spark.createDataFrame([(i, f"w{i} w{i + 1} w{29 - i}", f"d{i % 3}" if i % 2 else None) for i in range(10)], "qid int, text string, want string")
    truth, path = {}, str(tmp_path / "live")
    index = LiveIndex(spark, path)
    for n in range(4):
        batch = [(f"c{rng.randrange(60)}", f"d{rng.randrange(3)}", draw() if rng.random() < 0.8 else None, v) for v in range(40)]
        if n == 2:
            batch = [(c, d, None, v) for c, d, _, v in batch]
        truth.update({c: (d, t) for c, d, t, _ in batch})
        df = spark.createDataFrame(batch, schema).repartition(3)
        for _ in range(2):
            index = index.upsert(df, n, ["version"], fold_after=2, shard_rows=16)
        now = spark.createDataFrame([(c, d, t) for c, (d, t) in truth.items() if t is not None], "chunk_id string, doc_urn string, text string")
        for want in (None, "want"):
            assert rows(index.search(q, 5, want)) == rows(sparse_topk(q, now, 5, filter_doc=want))
    assert len(index.folders) <= 2 and index.last_batch == {"": 3}
    src = tmp_path / "in"
    spark.createDataFrame([(f"s{i}", "d0", "w1 w2 neu", 0) for i in range(5)], schema).write.parquet(str(src))
    jobs.stream_live_index(jobs.table_stream(spark, str(src), "*.parquet"), str(tmp_path / "other"), str(tmp_path / "ck"), ["version"])
    assert LiveIndex(spark, str(tmp_path / "other")).search(spark.createDataFrame([(1, "neu")], "qid int, text string"), 3).count() == 3
    # Another stream counts its batches from 0 again: they are not taken for the first one's.
    more = tmp_path / "more"
    spark.createDataFrame([("t1", "d0", "w1 nuovissimo", 0)], schema).write.parquet(str(more))
    jobs.stream_live_index(jobs.table_stream(spark, str(more), "*.parquet"), str(tmp_path / "other"), str(tmp_path / "ck2"), ["version"])
    assert LiveIndex(spark, str(tmp_path / "other")).search(spark.createDataFrame([(1, "nuovissimo")], "qid int, text string"), 3).count() == 1


def test_archive_members_and_broken_ones(spark, tmp_path):
    """Ranges of any width, a member with a flipped byte, a cut archive, one that is no archive; the stream takes in new ones."""
    import zipfile

    from pandekt.sources import archive as ar

    folder = tmp_path / "zips"
    folder.mkdir()
    texts = {f"m{i}.xml": (f"<x>{i}</x>" * (1 + i * 7)).encode() for i in range(30)}

    def make(name, members):
        with zipfile.ZipFile(folder / name, "w", zipfile.ZIP_DEFLATED) as z:
            for m in members:
                z.writestr(m, texts[m])

    make("a.zip", list(texts)[:20])
    make("b.zip", list(texts)[20:])
    with zipfile.ZipFile(folder / "b.zip") as z:
        broken = z.infolist()[3]
    data = bytearray((folder / "b.zip").read_bytes())
    data[broken.header_offset + 30 + len(broken.filename) + 2] ^= 0xFF
    (folder / "b.zip").write_bytes(data)
    (folder / "c.zip").write_bytes((folder / "a.zip").read_bytes()[:200])
    assert {r.archive[-5:]: r.n_members for r in ar.index_archives(spark, str(folder)).collect()} == {"a.zip": 20, "b.zip": 10, "c.zip": 1}
    assert ar.index_archives(spark, str(folder)).count() == 0
    for width in (50, 1000, 1 << 25):
        got = ar.read_archives(spark, str(folder), width).collect()
        assert {r.member: bytes(r.raw) for r in got if r.error is None} == {m: t for m, t in texts.items() if m != broken.filename}
        assert sorted((r.archive[-5:], r.member) for r in got if r.error is not None) == [("b.zip", broken.filename), ("c.zip", None)]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    jobs.run_available(ar.read_archives(spark, str(folder), stream=True).select("archive", "member"), out, ck)
    assert spark.read.parquet(out).count() == 31
    make("d.zip", list(texts)[:2])
    ar.index_archives(spark, str(folder))
    jobs.run_available(ar.read_archives(spark, str(folder), stream=True).select("archive", "member"), out, ck)
    assert spark.read.parquet(out).groupBy("archive").count().count() == 4 and spark.read.parquet(out).count() == 33


def test_pages_are_parsed_in_runs():
    pages = pd.DataFrame({"page_id": [1, 2, 3, 4], "html": ["x" * 700_000, None, "y" * 700_000, "z"]})
    assert [[page for page, _ in run] for run in mk._page_runs(pages, "page_id", "html")] == [[1, 2, 3], [4]]
    assert list(mk._page_runs(pages.iloc[:0], "page_id", "html")) == []
