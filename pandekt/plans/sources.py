"""Sources, sinks and the chunk index over the driver tables."""

from pyspark.sql import functions as F

from pandekt.functions.ids import point_id
from pandekt.functions.vectors import l2_normalize
from pandekt.operators import structure as st
from pandekt.plans.base import chunks, lines, order_hits, ORDER_HITS_SQL
from pandekt.plans.registry import query
from pandekt.plans.sqlbits import CHUNKS, SPACE
from pandekt.plans.structure import STRIP
from pandekt.session import scratch_path
from pandekt.sources import archive as ar
from pandekt.sources import index as ix
from pandekt.sources import manifest as mf
from pandekt.sources import markup as mk


@query("a1_scan_manifest", """SELECT 'src' || n_nationkey AS key, n_name AS title, CASE WHEN d.n IS NULL THEN 'missing' ELSE 'read' END AS status, coalesce(d.n, 0) AS n_rows
FROM nation LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) d ON d.source = 'src' || n_nationkey""")
def manifest(t):
    m = t.nation.select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("title"))
    return mf.scan_manifest(m, t.documents.select(F.col("source").alias("key"))).select("key", "title", "status", "n_rows")


@query("a1_archive_members", """SELECT source AS archive, 'd' || doc_id || '.txt' AS member, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest, CAST(NULL AS VARCHAR) AS error FROM documents""")
def archive_members(t):
    """Documents packed into archives by source, then read back by byte range through the data source."""
    folder = scratch_path(t.spark, "archives")
    d = t.documents.select("source", F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), F.col("text").cast("binary").alias("raw"))
    ar.write_archives(d.repartition("source"), folder, "member", "raw").count()
    ar.index_archives(t.spark, folder)
    rows = ar.read_archives(t.spark, folder, 1 << 16)
    return rows.select(F.split_part("member", F.lit("/"), F.lit(1)).alias("archive"), F.split_part("member", F.lit("/"), F.lit(2)).alias("member"), "size", F.md5("raw").alias("digest"), "error")


def xml_documents(t):
    """Documents as law XML: one chapter per text, its lines as numbered paragraphs.

    German texts have no chapter level; lines starting with a vowel get no number.
    """
    def esc(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    n = F.col("doc_id").cast("string")
    paras = F.transform(lines(F.col("text")), lambda x, i: F.concat(
        F.lit('<paragraph eId="p'), (i + 1).cast("string"), F.lit('">'),
        F.when(~x.rlike("^[AEIOU]"), F.concat(F.lit("<num>"), (i + 1).cast("string"), F.lit(".</num>"))).otherwise(F.lit("")),
        F.lit("<content><p><ref href='x'>"), esc(x), F.lit("</ref></p></content></paragraph>")))
    article = F.concat(F.lit('<article eId="art_'), n, F.lit('"><num>Art. '), n, F.lit(".</num><heading>"), "source", F.lit("</heading>"), F.array_join(paras, ""), F.lit("</article>"))
    body = F.when(F.col("lang") == "de", article).otherwise(
        F.concat(F.lit('<chapter eId="chp_1"><num>Capo I</num><heading>Lingua <ins>'), "lang", F.lit("</ins></heading>"), article, F.lit("</chapter>")))
    return t.documents.select("doc_id", F.concat(
        F.lit('<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><body>'), body, F.lit("</body></act></akomaNtoso>")).alias("xml"))


@query("a2_xml_sections", f"""WITH dl AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE 'chp_1' END AS chapter_eid, CASE WHEN lang <> 'de' THEN 'Capo I' END AS chapter_number, CASE WHEN lang <> 'de' THEN 'Lingua ' || lang END AS chapter_title,
  'art_' || doc_id AS article_eid, CAST(doc_id AS VARCHAR) AS article_number, source AS rubrica, 'p' || i AS para_eid, CAST(i AS VARCHAR) AS para_number,
  trim(i || '.' || regexp_replace(line, '{SPACE}', ' ', 'g')) AS para_text FROM dl WHERE NOT regexp_matches(line, '^[AEIOU]')""")
def xml(t):
    rows = mk.xml_sections(xml_documents(t), "xml", ["doc_id"])
    return rows.filter("para_eid IS NOT NULL").select("doc_id", "chapter_eid", "chapter_number", "chapter_title", "article_eid", "article_number", "rubrica",
                                                      "para_eid", "para_number", "para_text")


@query("a3_html_sections")
def html_sections(t):
    rules = mk.HtmlRules(noise_classes=frozenset({"ad"}))
    return mk.html_sections(t.pages, "page_id", "html", rules)


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_documents(t):
    """Documents as law pages: an article per text in a chapter per language, its lines as children.

    Every other line is numbered, each number followed by a table that belongs to
    it and by a note that is noise; texts of one line have no number. Paragraphs
    are left unclosed.
    """
    n = F.col("doc_id").cast("string")
    l = lines(F.col("text"))
    para = F.transform(l, lambda x, i: F.when((i % 2 == 0) & (F.size(l) > 1), F.concat(
        F.lit("<div>"), (i + 1).cast("string"), F.lit('. <i>'), _escaped(x), F.lit('</i><span class="x footnote">nota <b>a</b></span> coda<table><tr><td>a)<td> prima regola</table></div>'))).otherwise(
        F.concat(F.lit('<p class="oj-normal">'), _escaped(x))))
    article = F.concat(F.lit('<div id="art_'), n, F.lit('"><p class="title-article-norm">Articolo '), n, F.lit('</p><div class="eli-title"><p>Oggetto <b>'), "source", F.lit("</b></div>"),
                       F.array_join(para, "\n"), F.lit("<script>var x = '<p>1. no';</script></div>"))
    return t.documents.select("doc_id", F.concat(
        F.lit('<!DOCTYPE html><html><body><p>indice<div id="cpt_I"><p class="title-division-1">CAPO I</p><p class="title-division-2">Lingua '), "lang", F.lit("</p>"), article, F.lit("</div></body></html>")).alias("html"))


@query("a3_html_articles", f"""WITH dl AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, lang, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM dl),
s AS (SELECT *, trim(regexp_replace(replace(line, chr(160), ' '), '{SPACE}', ' ', 'g')) AS t FROM l)
SELECT doc_id, 'art_' || doc_id AS section_id, CAST(doc_id AS VARCHAR) AS marker, 'Oggetto ' || source AS heading, 'cpt_I' AS chapter_id, 'Lingua ' || lang AS chapter_title, CAST(i AS VARCHAR) AS number,
  trim(trim(regexp_replace(line, '{SPACE}', ' ', 'g'), ' ') || ' coda' || 'a) prima regola') AS text FROM s WHERE n > 1 AND i % 2 = 1 AND t <> ''
UNION ALL SELECT doc_id, 'art_' || doc_id, CAST(doc_id AS VARCHAR), 'Oggetto ' || source, 'cpt_I', 'Lingua ' || lang, NULL, t FROM s WHERE n = 1""")
def html_articles(t):
    rows = mk.html_sections(html_documents(t), "doc_id", "html")
    return rows.filter("section_id <> '' AND NOT (number IS NOT NULL AND text = 'codaa) prima regola')").select("doc_id", "section_id", "marker", "heading", "chapter_id", "chapter_title", "number", "text")


@query("a4_html_text_without_noise", rf"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script(\s[^>]*)?>.*?</script\s*>', '', 'g'), '(?is)<style(\s[^>]*)?>.*?</style\s*>', '', 'g'), '(?is)<nav(\s[^>]*)?>.*?</nav\s*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<(div|p|span)\s[^>]*class="ad"[^>]*>.*?</(div|p|span)\s*>', '', 'g'), '(?s)<[^>]*>', '', 'g') AS h FROM b),
d AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g') AS h FROM c)
SELECT page_id, trim(regexp_replace(h, '{SPACE}', ' ', 'g')) AS text FROM d""")
def html_text(t):
    return t.pages.select("page_id", mk.html_text(F.col("html"), noise_classes=("ad",)).alias("text"))


@query("a4_nested_noise", r"""
SELECT doc_id, trim(regexp_replace('Art. ' || doc_id || ' ' || source || 're' || source || lang || ' end ' || lang, '[\s\x0B\p{Z}]+', ' ', 'g')) AS text FROM documents""")
def nested_noise(t):
    """Pages made of the documents' columns: inline tags inside words, noise in noise, comments, void and unclosed elements."""
    d = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("n"), "source", "lang")
    page = F.concat(F.lit("<html><body><h1>Art. "), "n", F.lit("</h1> <p>"), "source", F.lit("re<i>"), "source", F.lit("</i><!-- no -->"), "lang",
                    F.lit('</p><div class="x modified">out<div>in <span class="modified">deep</span></div>out<br></div><script>if (a < b) { "<p>" }</script> <ul><li>end<nav><p>menu</nav>&nbsp;'), "lang", F.lit("</body>"))
    return d.select("doc_id", mk.html_text(page, noise_classes=("modified",)).alias("text"))


@query("a5_numbered_units", f"""WITH dl AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS number, regexp_replace(' (' || i || ') ' || line, '^\\s*\\(\\s*\\d+\\s*\\)\\s*', '') AS text FROM dl WHERE lang IN ('en', 'fr')""")
def units(t):
    l = t.documents.select("doc_id", "lang", F.posexplode(lines(F.col("text"))).alias("p", "line"))
    n = (F.col("p") + 1).cast("string")
    prefix = F.when(F.col("lang").isin("en", "fr"), F.lit("rct_")).when(F.col("lang") == "de", F.lit("rct_x")).otherwise(F.lit("cit_"))
    u = l.select("doc_id", F.concat(prefix, n).alias("eid"), F.concat(F.lit(" ("), n, F.lit(") "), "line").alias("text"))
    return st.numbered_units(u, "eid", "text", "rct_").select("doc_id", "number", "text")


@query("a6_nested_points")
def points(t):
    return mk.nested_points(t.pages, "page_id", "html")


@query("a6_nested_tables", f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
c AS (SELECT doc_id, i, trim(regexp_replace(replace(line, chr(160), ' '), '{SPACE}', ' ', 'g')) AS t FROM s)
SELECT doc_id, CAST(0 AS INTEGER) AS list_pos, CAST(i AS INTEGER) AS point, CAST(2 AS INTEGER) AS n_children, trim(i || '. ' || t) || chr(10) || '    a) ' || i || chr(10) || '    b)' || chr(10) || '        fine' AS text FROM c""")
def tables(t):
    """Lines as rows of one table per document; each holds a table of two lettered rows, the second with a list in it."""
    row = F.transform(lines(F.col("text")), lambda x, i: F.concat(
        F.lit("<tr><td>"), (i + 1).cast("string"), F.lit(".</td><td><p>"), _escaped(x), F.lit("</p><nav>menu</nav><table><tr><td>a)<td>"), (i + 1).cast("string"),
        F.lit("<tr><td>b)<td><ul><li>fine</ul></table></td></tr>")))
    html = F.concat(F.lit("<table><tbody>"), F.array_join(row, "\n"), F.lit("</tbody></table>"))
    return mk.nested_points(t.documents.select("doc_id", html.alias("html")), "doc_id", "html").drop("title")


@query("a6_point_title", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT doc_id, i, trim(string_split(replace(line, ',', ':'), ':')[1]) AS h FROM l)
SELECT doc_id, i AS line_no, CASE WHEN length(h) <= 60 THEN h ELSE rtrim(coalesce(nullif(regexp_extract(substr(h, 1, 60), '(?s)^(.+) [^ ]*$', 1), ''), substr(h, 1, 60))) END AS title FROM h""")
def titles(t):
    l = t.documents.select("doc_id", F.posexplode(lines(F.replace("text", F.lit(","), F.lit(":")))).alias("p", "line"))
    return l.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), mk.point_title(F.col("line")).alias("title"))


MARKS = {"section": "A", "article": "[B-F]", "paragraph": "[G-P]", "note": "[WZ]"}


@query("a7_line_segmenter", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT *, max(i) FILTER (regexp_matches(line, '^A')) OVER w AS ls, max(i) FILTER (regexp_matches(line, '^[B-F]')) OVER w AS la FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, {STRIP % 'line'} AS s FROM m WHERE la > coalesce(ls, 0) AND i <> la),
n AS (SELECT *, count(*) FILTER (regexp_matches(line, '^[ \\t]*[WZ]')) OVER w AS nn FROM b WINDOW w AS (PARTITION BY doc_id, la ORDER BY i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CASE WHEN nn = 0 THEN count(*) FILTER (nn = 0 AND regexp_matches(line, '^[ \\t]*[G-P]')) OVER w ELSE nn END AS u FROM n WINDOW w AS (PARTITION BY doc_id, la ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT p.doc_id, sl.line AS section, al.line AS header, CASE WHEN nn > 0 THEN 'note' ELSE 'paragraph' END AS kind, CAST(u - 1 AS INTEGER) AS unit_pos,
  CASE WHEN nn > 0 THEN coalesce(string_agg(s, ' ' ORDER BY p.i) FILTER (s <> ''), '') ELSE {STRIP % "string_agg(s, chr(10) ORDER BY p.i)"} END AS unit_text
FROM p LEFT JOIN l sl ON sl.doc_id = p.doc_id AND sl.i = p.ls JOIN l al ON al.doc_id = p.doc_id AND al.i = p.la WHERE u > 0
GROUP BY p.doc_id, p.la, sl.line, al.line, nn > 0, u""")
def segments(t):
    d = t.documents.select("doc_id", "text")
    return st.line_segmenter(d, "text", **MARKS).select("doc_id", "section", "header", "kind", "unit_pos", "unit_text")


@query("a8_content_gate", r"""
WITH p AS (SELECT page_id, CASE WHEN url LIKE '%.org%' THEN 'application/xml; charset=utf-8' WHEN url LIKE '%.net%' THEN ' Text/HTML; charset=utf-8' END AS ct,
  CASE WHEN url LIKE 'https://m.%' THEN 'x' || html ELSE '  ' || html END AS html FROM pages)
SELECT page_id, CASE WHEN coalesce(trim(split_part(ct, ';', 1)), '') <> '' AND NOT starts_with(lower(trim(split_part(ct, ';', 1))), 'text/html') THEN 'content_type'
  WHEN octet_length(encode(html)) < 2000 THEN 'too_small' WHEN NOT (starts_with(lower(ltrim(html)), '<!doctype') OR starts_with(lower(ltrim(html)), '<html')) THEN 'not_html' END AS reject_reason FROM p""")
def gate(t):
    u = F.col("url")
    p = t.pages.select("page_id", F.when(u.contains(".org"), "application/xml; charset=utf-8").when(u.contains(".net"), " Text/HTML; charset=utf-8").alias("ct"),
                       F.when(u.startswith("https://m."), F.concat(F.lit("x"), "html")).otherwise(F.concat(F.lit("  "), "html")).alias("html"))
    return mf.content_gate(p, "ct", "html", 2000).select("page_id", "reject_reason")


@query("a9_extract_link", r"""WITH h AS (SELECT page_id, regexp_extract(replace(html, 'href="/', 'href="/x?a=1&amp;b='), 'href="([^"]+)"', 1) AS href FROM pages)
SELECT page_id, CASE WHEN href = '' THEN NULL WHEN starts_with(href, '/') THEN 'https://example.org' || replace(href, '&amp;', '&') ELSE replace(href, '&amp;', '&') END AS link FROM h""")
def link(t):
    html = F.replace("html", F.lit('href="/'), F.lit('href="/x?a=1&amp;b='))
    return t.pages.select("page_id", mf.extract_link(html, r'href="([^"]+)"', "https://example.org").alias("link"))


@query("a10_point_id", f"""WITH {CHUNKS}, s AS (SELECT chunk_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM chunks)
SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM s""")
def ids(t):
    return chunks(t).select("chunk_id", point_id(F.col("chunk_id")).alias("point_id"))


def index_rows(t):
    c = ix.with_point_id(chunks(t))
    return c.select("point_id", "chunk_id", "doc_urn", "text", F.lit(0).alias("version"))


def index_update(t):
    """Labelled documents come again, in two versions of which the later counts; plus one new row per label value."""
    c = ix.with_point_id(chunks(t)).join(t.labels, "doc_id")
    v = c.select("point_id", "chunk_id", "doc_urn", F.concat("text", F.lit(" [v2]")).alias("text"), F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))
    new = t.labels.select("quality").distinct().select(F.concat(F.lit("new__art_"), F.col("quality").cast("string")).alias("chunk_id")).select(
        point_id(F.col("chunk_id")).alias("point_id"), "chunk_id", F.lit("new").alias("doc_urn"), F.lit("x").alias("text"), F.lit(1).alias("version"))
    return v.unionByName(new)


@query("a11_upsert_index", f"""WITH {CHUNKS}
SELECT chunk_id, doc_urn, md5(CASE WHEN l.doc_id IS NULL THEN text ELSE text || ' [v2]' END) AS digest, CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 2 END AS INTEGER) AS version FROM chunks c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = c.doc_id
UNION ALL SELECT 'new__art_' || quality, 'new', md5('x'), CAST(1 AS INTEGER) FROM (SELECT DISTINCT quality FROM labels)""")
def upsert(t):
    new = index_update(t)
    once = ix.merge_upsert(index_rows(t), new, order=["version"])
    twice = ix.merge_upsert(once, new, order=["version"])
    return twice.select("chunk_id", "doc_urn", F.md5(F.col("text").cast("binary")).alias("digest"), "version")


@query("a12_scan_projection", "SELECT doc_id, source, lang FROM documents")
def projection(t):
    return mf.scan_projection(t.spark, f"{t.sf_dir}/documents.parquet", ["doc_id", "source", "lang"])


@query("a13_lookup_by_id", "SELECT p_partkey AS doc_id, p_name, coalesce(text, '') AS text FROM part LEFT JOIN documents ON doc_id = p_partkey")
def lookup(t):
    return mf.lookup_by_id(t.part.select(F.col("p_partkey").alias("doc_id"), "p_name"), t.documents, "doc_id")


@query("a13_orphans", "SELECT DISTINCT p_partkey AS doc_id FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM documents)")
def orphans(t):
    return mf.orphans(t.part.select(F.col("p_partkey").alias("doc_id")), t.documents, "doc_id")


@query("a14_nested_json", f"WITH {ORDER_HITS_SQL} SELECT qid, rank, chunk_id, score FROM hits")
def nested(t):
    from pandekt.session import scratch_path
    path = scratch_path(t.spark, "nested")
    ix.write_nested(ix.nest_results(order_hits(t)), path)
    return ix.read_nested(t.spark, path, "bigint")


def raw_links(t):
    """Lines as JSON link records, some of them faulty."""
    l = t.lineitem
    n = F.col("l_linenumber")
    rel = F.element_at(F.array(*[F.lit(r) for r in ix.RELATIONS], F.lit("boh")), F.least(n, F.lit(6)))
    rec = F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("from"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("to"),
                   rel.alias("relation"), F.when(n != 7, F.lit("x")).alias("note"),
                   F.when(F.col("l_returnflag") == "A", "curated").when(F.col("l_returnflag") == "N", "auto").when(F.col("l_discount") > 0.08, "manual").alias("source"),
                   F.when((n == 2) & (F.col("l_linestatus") == "O"), F.col("l_quantity")).alias("weight"))
    return l.select("l_orderkey", F.to_json(rec).alias("json"))


LINKS_SQL = """
r AS (SELECT l_orderkey, 'P' || l_partkey AS from_chunk, 'S' || l_suppkey AS to_chunk, list_extract(['complementare', 'presupposto_di', 'rinvia_a', 'attua', 'deroga', 'boh'], least(l_linenumber, 6)) AS relation,
  CASE WHEN l_linenumber <> 7 THEN 'x' END AS note, coalesce(CASE WHEN l_returnflag = 'A' THEN 'curated' WHEN l_returnflag = 'N' THEN 'auto' WHEN l_discount > 0.08 THEN 'manual' END, 'curated') AS source,
  l_linenumber = 2 AND l_linestatus = 'O' AS extra FROM lineitem),
v AS (SELECT *, CASE WHEN note IS NULL THEN 'missing_field' WHEN extra THEN 'unknown_field' WHEN relation = 'boh' THEN 'relation' WHEN source = 'manual' THEN 'source' END AS violation FROM r)"""


@query("a15_edge_source", f"WITH {LINKS_SQL} SELECT l_orderkey, from_chunk, to_chunk, relation, note, source, violation FROM v")
def links(t):
    return ix.parse_links(raw_links(t), "json")


@query("a15_duplicate_links", f"WITH {LINKS_SQL} SELECT from_chunk, to_chunk, relation, count(*) AS n FROM v WHERE violation IS NULL GROUP BY ALL HAVING count(*) > 1")
def duplicates(t):
    return ix.duplicate_links(links(t))
