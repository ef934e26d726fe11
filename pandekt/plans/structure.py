"""Structuring and chunking of documents, orders and lines."""

from pyspark.sql import functions as F

from pandekt.functions import ids
from pandekt.functions.text import article_sort_key, clean_heading, count_tokens, excerpt, iso_date, roman_to_int
from pandekt.operators import chunking as ch
from pandekt.operators import structure as st
from pandekt.operators.ordered import row_positions
from pandekt.operators.packing import pack_greedy
from pandekt.plans.base import lines
from pandekt.plans.registry import query
from pandekt.plans.sqlbits import NTOK
from pandekt.session import cut_lineage

STRIP = r"regexp_replace(%s, '^[\s\x0B\p{Z}]+|[\s\x0B\p{Z}]+$', '', 'g')"
DOC_LINES = "dl AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


@query("b1_doc_metadata", r"""
WITH u AS (SELECT o_orderkey, '/akn/it/act/' || lower(substr(o_orderpriority, 3)) || '/stato/' || CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'P' THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END || '/' || o_orderkey AS urn,
  CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'P' THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS raw_date,
  CASE o_orderstatus WHEN 'O' THEN 'Direttiva sul Regolamento' WHEN 'P' THEN 'Decisione o direttiva' ELSE 'Atto ' || o_orderpriority END AS title FROM orders)
SELECT o_orderkey, regexp_extract(urn, '^/akn/[^/]+/act/([^/]+)/', 1) AS doc_type, regexp_extract(urn, '/act/[^/]+/[^/]+/[^/]+/([^/]+)(?:/|$)', 1) AS number,
  CASE WHEN regexp_matches(raw_date, '^\d{4}-\d{2}-\d{2}$') THEN TRY_CAST(raw_date AS DATE) END AS promulgated,
  CASE WHEN upper(title) LIKE '%REGOLAMENTO%' THEN 'regulation' WHEN upper(title) LIKE '%DIRETTIVA%' THEN 'directive' WHEN upper(title) LIKE '%DECISIONE%' THEN 'decision' ELSE '' END AS title_type FROM u""")
def metadata(t):
    o = t.orders
    raw = (F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
           .when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy")))
    urn = F.concat(F.lit("/akn/it/act/"), F.lower(F.substring("o_orderpriority", 3, 100)), F.lit("/stato/"), raw, F.lit("/"), F.col("o_orderkey").cast("string"))
    title = (F.when(F.col("o_orderstatus") == "O", "Direttiva sul Regolamento").when(F.col("o_orderstatus") == "P", "Decisione o direttiva")
             .otherwise(F.concat(F.lit("Atto "), "o_orderpriority")))
    return o.select("o_orderkey", st.doc_type_of(urn).alias("doc_type"), st.doc_number_of(urn).alias("number"),
                    iso_date(raw).alias("promulgated"), st.type_from_title(title).alias("title_type"))


CELEX = """'3' || strftime(o_orderdate, '%Y') || CASE WHEN o_orderpriority LIKE '1%' THEN 'X' WHEN o_orderstatus = 'F' THEN 'R' WHEN o_orderstatus = 'O' THEN 'L' ELSE 'D' END || lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(4, len(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0')"""


@query("b2_doc_urn", f"""WITH c AS (SELECT o_orderkey, {CELEX} AS celex FROM orders)
SELECT o_orderkey, celex, CASE WHEN regexp_matches(celex, '^3\\d{{4}}[A-Z]\\d{{4}}$') THEN 'eli/' || CASE substr(celex, 6, 1) WHEN 'R' THEN 'reg' WHEN 'L' THEN 'dir' WHEN 'D' THEN 'dec' ELSE lower(substr(celex, 6, 1)) END
  || '/' || substr(celex, 2, 4) || '/' || CAST(substr(celex, 7) AS INTEGER) || '/oj' ELSE 'celex/' || celex END AS doc_urn FROM c""")
def doc_urn(t):
    cust = F.col("o_custkey").cast("string")
    letter = (F.when(F.col("o_orderpriority").startswith("1"), "X").when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "L").otherwise("D"))
    celex = F.concat(F.lit("3"), F.date_format("o_orderdate", "yyyy"), letter, F.when(F.length(cust) < 4, F.lpad(cust, 4, "0")).otherwise(cust))
    return t.orders.select("o_orderkey", celex.alias("celex"), ids.celex_doc_urn(celex).alias("doc_urn"))


@query("b3_article_number", r"""
WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Art. ' || o_orderkey || '-bis.' WHEN 'O' THEN ' ' || o_orderkey || '. ' WHEN 'P' THEN '' END AS raw, 'art_' || o_orderkey AS eid FROM orders)
SELECT o_orderkey, coalesce(nullif(rtrim(regexp_extract(raw, '(?i)Art\.?\s*([^\s.]+)', 1), '.'), ''), nullif(rtrim(trim(raw), '.'), ''), substr(eid, 5)) AS number FROM r""")
def number(t):
    k = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Art. "), k, F.lit("-bis."))).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit(" "), k, F.lit(". "))).otherwise("")
    return t.orders.select("o_orderkey", ids.article_number(raw, F.concat(F.lit("art_"), k)).alias("number"))


@query("b4_repealed_filter", f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CASE WHEN contains(l[1], 'Sch') OR contains(l[1], 'Eau') OR contains(l[1], 'Th') THEN 'repealed'
  WHEN starts_with({STRIP % "coalesce(l[2], '')"}, 'De') OR starts_with({STRIP % "coalesce(l[2], '')"}, 'An') OR starts_with({STRIP % "coalesce(l[2], '')"}, 'Er') THEN 'repealed'
  WHEN contains(upper(text), 'TION') THEN 'residual' ELSE 'active' END AS status FROM d""")
def repealed(t):
    l = lines(F.col("text"))
    return t.documents.select("doc_id", st.repeal_class(l[0], F.get(l, F.lit(1)), F.col("text"), ["Sch", "Eau", "Th"], ["De", "An", "Er"], "TION").alias("status"))


def line_chapters(t):
    """Every document line as a chapter whose kind follows its first letter."""
    l = t.documents.select(F.col("doc_id").alias("doc_urn"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    p = F.col("pos").cast("string")
    num = (F.when(F.col("line").rlike("^[A-D]"), F.concat(F.lit("TITOLO "), p)).when(F.col("line").rlike("^[E-J]"), F.concat(F.lit("Capo "), p))
           .when(F.col("line").rlike("^[K-S]"), F.concat(F.lit(" sezione "), p, F.lit("-bis"))).when(F.col("line").rlike("^T"), F.lit("Parte I")))
    title = F.when(F.col("line").contains("the"), F.concat(F.lit("Norme SEZIONE "), p)).otherwise(F.lit("Norme"))
    return l.select("doc_urn", "pos", num.alias("number"), title.alias("title"))


@query("b5_carry_hierarchy", f"""WITH {DOC_LINES},
e AS (SELECT doc_id AS doc_urn, CAST(i - 1 AS INTEGER) AS pos,
  CASE WHEN regexp_matches(line, '^[A-D]') THEN 'Titolo ' || (i - 1) END AS t, CASE WHEN regexp_matches(line, '^[E-J]') THEN 'Capo ' || (i - 1) END AS c,
  CASE WHEN regexp_matches(line, '^[E-J]') THEN CASE WHEN contains(line, 'the') THEN 'Sezione ' || (i - 1) ELSE '' END WHEN regexp_matches(line, '^[K-S]') THEN 'Sezione ' || (i - 1) || '-BIS' END AS s FROM dl)
SELECT doc_urn, pos, last_value(t IGNORE NULLS) OVER w AS titolo, last_value(c IGNORE NULLS) OVER w AS capo, nullif(last_value(s IGNORE NULLS) OVER w, '') AS sezione
FROM e WINDOW w AS (PARTITION BY doc_urn ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def hierarchy(t):
    return st.carry_hierarchy(line_chapters(t)).select("doc_urn", "pos", "titolo", "capo", "sezione")


@query("b6_assign_chapter", """
WITH a AS (SELECT user_id, event_type || '/' || CAST(ts AS DATE) AS eid, min(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY ALL),
s AS (SELECT user_id, 'ch' || event_id AS chapter_id, ts AS start_pos, least(ts + INTERVAL 12 HOUR, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - INTERVAL 1 MICROSECOND, TIMESTAMP '9999-01-01')) AS end_pos FROM events WHERE event_type = 'signup')
SELECT a.user_id, a.ts, a.eid, round(a.value, 6) AS value, coalesce(s.chapter_id, '') AS chapter_id FROM a LEFT JOIN s ON s.user_id = a.user_id AND a.ts BETWEEN s.start_pos AND s.end_pos""")
def chapters(t):
    e = t.events
    arts = st.dedup_articles(e.select("user_id", F.concat_ws("/", "event_type", F.to_date("ts").cast("string")).alias("eid"), "ts", "value"), "user_id", "eid", "ts", ["value"])
    placed = row_positions(e.filter("event_type = 'signup'").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    after = placed.select("user_id", (F.col("pos") - 1).alias("pos"), F.col("ts").alias("next_ts"))
    spans = placed.join(after, ["user_id", "pos"], "left").select(
        "user_id", F.concat(F.lit("ch"), F.col("event_id").cast("string")).alias("chapter_id"), F.col("ts").alias("start_pos"),
        F.least(F.col("ts") + F.expr("INTERVAL 12 HOURS"), F.col("next_ts") - F.expr("INTERVAL 0.000001 SECONDS")).alias("end_pos"))
    return st.assign_chapter(arts, spans, "user_id", "ts").withColumn("value", F.round("value", 6))


def articles(t):
    """Documents as articles, their lines as paragraphs (one line: body without number)."""
    l = lines(F.col("text"))
    n = F.col("doc_id").cast("string")
    eid = F.concat(F.lit("art_"), n)
    para = F.when(F.size(l) == 1, F.array(F.struct(F.concat(eid, F.lit("__body")).alias("eid"), F.lit(None).cast("string").alias("number"), l[0].alias("text")))).otherwise(
        F.transform(l, lambda x, i: F.struct(F.concat(eid, F.lit("__para_"), (i + 1).cast("string")).alias("eid"), (i + 1).cast("string").alias("number"), x.alias("text"))))
    return t.documents.select(F.col("source").alias("doc_urn"), eid.alias("article_eid"), n.alias("number"), F.col("lang").alias("rubrica"),
                              F.array(F.col("source"), F.concat(F.lit("art. "), n)).alias("hierarchy_path"), para.alias("paragraphs"))


RENDERED = f"""
pr AS (SELECT doc_id, source, lang, i, line, CASE WHEN nl = 1 OR starts_with({STRIP % 'line'}, i || '.') OR starts_with({STRIP % 'line'}, i || ' ') THEN {STRIP % 'line'} ELSE i || '. ' || {STRIP % 'line'} END AS r, nl
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS nl FROM dl)),
fu AS (SELECT doc_id, source, any_value(lang) AS lang, any_value(nl) AS nl, 'Articolo ' || doc_id || ' - ' || any_value(lang) || coalesce(chr(10) || chr(10) || string_agg(r, chr(10) || chr(10) ORDER BY i) FILTER (line <> ''), '') AS full_text FROM pr GROUP BY doc_id, source)"""


@query("b7_render_article", f"WITH {DOC_LINES},{RENDERED} SELECT doc_id, md5(full_text) AS digest, length(full_text) AS n FROM fu")
def render(t):
    a = articles(t).select(F.col("number").cast("long").alias("doc_id"), ch.render_article("Articolo", F.col("number"), F.col("rubrica"), F.col("paragraphs")).alias("x"))
    return a.select("doc_id", F.md5(F.col("x").cast("binary")).alias("digest"), F.length("x").cast("long").alias("n"))


@query("b7_render_paragraph", f"WITH {DOC_LINES},{RENDERED} SELECT doc_id, i AS para, r AS rendered FROM pr")
def render_para(t):
    a = articles(t).select(F.col("number").cast("long").alias("doc_id"), F.posexplode("paragraphs").alias("p", "x"))
    return a.select("doc_id", (F.col("p") + 1).cast("long").alias("para"), ch.render_paragraph(F.col("x.number"), F.col("x.text")).alias("rendered"))


@query("b8_count_tokens", f"SELECT doc_id, CAST({NTOK % 'text'} AS BIGINT) AS n_tokens FROM documents")
def tokens(t):
    return t.documents.select("doc_id", count_tokens(F.col("text")).cast("long").alias("n_tokens"))


@query("b9_pack_greedy", """
WITH RECURSIVE p AS (SELECT l_orderkey, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos FROM lineitem),
r AS (SELECT l_orderkey, pos, x, x AS s, 0 AS g FROM p WHERE pos = 1
  UNION ALL SELECT p.l_orderkey, p.pos, p.x, CASE WHEN r.s + p.x > 100 THEN p.x ELSE r.s + p.x END, CASE WHEN r.s + p.x > 100 THEN r.g + 1 ELSE r.g END FROM r JOIN p ON p.l_orderkey = r.l_orderkey AND p.pos = r.pos + 1)
SELECT l_orderkey, CAST(g AS INTEGER) AS group_index, count(*) AS n_items, sum(x) AS tokens FROM r GROUP BY ALL""")
def pack(t):
    p = pack_greedy(t.lineitem.withColumn("tokens", F.col("l_quantity")), ["l_orderkey"],
                    ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "tokens", 100)
    return p.groupBy("l_orderkey", "group_index").agg(F.count(F.lit(1)).alias("n_items"), F.sum("tokens").alias("tokens"))


BUDGET = 200


def doc_chunks(t):
    return ch.build_chunks(articles(t), threshold=BUDGET)


PACKED = f"""
tk AS (SELECT doc_id, i, CAST({NTOK % 'r'} AS BIGINT) AS x FROM pr),
ft AS (SELECT *, CAST({NTOK % 'full_text'} AS BIGINT) AS n FROM fu),
rec AS (SELECT doc_id, i, x AS s, 0 AS g FROM tk WHERE i = 1
  UNION ALL SELECT tk.doc_id, tk.i, CASE WHEN rec.s + tk.x > {BUDGET} THEN tk.x ELSE rec.s + tk.x END, CASE WHEN rec.s + tk.x > {BUDGET} THEN rec.g + 1 ELSE rec.g END
  FROM rec JOIN tk ON tk.doc_id = rec.doc_id AND tk.i = rec.i + 1),
gr AS (SELECT pr.doc_id, rec.g, min(i) AS a, max(i) AS b, count(*) AS np, 'Articolo ' || pr.doc_id || ' - ' || any_value(lang) || coalesce(chr(10) || chr(10) || string_agg(r, chr(10) || chr(10) ORDER BY i) FILTER (line <> ''), '') AS text
  FROM pr JOIN rec USING (doc_id, i) GROUP BY pr.doc_id, rec.g),
chunks AS (SELECT source || '__art_' || doc_id AS chunk_id, 'article' AS chunk_type, source, n AS tokens, CASE WHEN n > {BUDGET} THEN TRUE END AS oversize, CAST(NULL AS INTEGER) AS group_index, CAST(NULL AS INTEGER) AS group_count,
    CAST(NULL AS VARCHAR) AS first_comma, CAST(NULL AS VARCHAR) AS last_comma, full_text AS text, 0 AS n_paras FROM ft WHERE n <= {BUDGET} OR nl = 1
  UNION ALL SELECT source || '__art_' || gr.doc_id || '__paras_' || a || '_' || b, 'article_group', source, CAST({NTOK % 'gr.text'} AS BIGINT), NULL, g, max(g) OVER (PARTITION BY gr.doc_id) + 1, CAST(a AS VARCHAR), CAST(b AS VARCHAR), gr.text, np
    FROM gr JOIN ft ON ft.doc_id = gr.doc_id WHERE NOT (n <= {BUDGET} OR nl = 1))"""


@query("b10_build_chunks", f"""WITH RECURSIVE {DOC_LINES},{RENDERED},{PACKED}
SELECT chunk_id, chunk_type, source AS doc_urn, CAST(tokens AS INTEGER) AS tokens, oversize, CAST(group_index AS INTEGER) AS group_index, CAST(group_count AS INTEGER) AS group_count, first_comma, last_comma, md5(text) AS digest, CAST(n_paras AS INTEGER) AS n_paras FROM chunks""")
def build(t):
    return doc_chunks(t).select("chunk_id", "chunk_type", "doc_urn", "metadata.tokens", "metadata.oversize", "metadata.group_index", "metadata.group_count",
                                "metadata.first_comma", "metadata.last_comma", F.md5(F.col("text").cast("binary")).alias("digest"), F.size("para_eids").alias("n_paras"))


def recitals(t):
    return t.conversations.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("doc_urn"), F.col("turn").alias("number"), "text")


def annexes(t):
    k = F.col("p_partkey").cast("string")
    return t.part.select(
        F.col("p_brand").alias("doc_urn"), F.when(F.col("p_size") > 25, F.concat(F.lit("III__point_"), k)).otherwise(k).alias("annex_id"),
        F.col("p_name").alias("title"), F.concat("p_name", F.lit("\n"), "p_type").alias("text"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("point"),
        F.lit(None).cast("int").alias("n_letters"), F.when(F.col("p_size") > 40, F.col("p_type")).alias("annex_title"))


@query("b11_build_unit_chunks", f"""
SELECT 'conv' || conv_id || '__recital_' || turn AS chunk_id, 'recital' AS chunk_type, 'Considerando ' || turn AS path, CAST({NTOK % "'Considerando ' || turn || chr(10) || chr(10) || text"} AS INTEGER) AS tokens, md5('Considerando ' || turn || chr(10) || chr(10) || text) AS digest FROM conversations
UNION ALL SELECT p_brand || '__annex_' || CASE WHEN p_size > 25 THEN 'III__point_' ELSE '' END || p_partkey, 'annex',
  CASE WHEN p_size > 25 THEN 'Allegato III - ' || CASE WHEN p_size > 40 THEN p_type ELSE p_name END || ' > ' || rtrim('Allegato III, punto ' || p_size || ': ' || p_name, ': ') ELSE 'Allegato ' || p_partkey || ' - ' || p_name END,
  CAST({NTOK % "p_name || chr(10) || p_type"} AS INTEGER), md5(p_name || chr(10) || p_type) FROM part""")
def units(t):
    both = ch.recital_chunks(recitals(t)).unionByName(ch.annex_chunks(annexes(t)))
    return both.select("chunk_id", "chunk_type", F.array_join("hierarchy_path", " > ").alias("path"), "metadata.tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("b12_assemble_corpus", f"""WITH RECURSIVE {DOC_LINES},{RENDERED},{PACKED},
u AS (SELECT 'eurlex' AS source_type, chunk_type FROM chunks UNION ALL SELECT 'eurlex', 'recital' FROM conversations UNION ALL SELECT 'eurlex', 'annex' FROM part)
SELECT source_type, chunk_type, count(*) AS n FROM u GROUP BY GROUPING SETS ((source_type), (chunk_type), ())""")
def corpus(t):
    return ch.corpus_counts(ch.assemble_corpus(doc_chunks(t), ch.recital_chunks(recitals(t)), ch.annex_chunks(annexes(t))))


ALLOWED = ["html", "head", "body", "title", "p", "h1", "article", "div", "b"]


@query("b13_unhandled_elements", r"""SELECT tag, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x))) AS tag FROM pages)
WHERE tag NOT IN ('html', 'head', 'body', 'title', 'p', 'h1', 'article', 'div', 'b') GROUP BY tag""")
def unhandled(t):
    tags = t.pages.select(F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    return st.unhandled_elements(tags.withColumn("tag", F.lower("tag")), ALLOWED)


@query("b14_chunk_invariants", "SELECT unnest(['duplicate_id', 'article_with_paragraphs', 'group_without_paragraphs', 'groups_differ_from_article', 'article_not_covered']) AS rule, CAST(0 AS BIGINT) AS n")
def invariants(t):
    # The rules look at ids only. They are written once: each rule would count all tokens anew.
    ids_only = cut_lineage(doc_chunks(t).select("chunk_id", "chunk_type", "doc_urn", "article_eid", "para_eids", F.struct("metadata.group_index").alias("metadata")))
    return ch.chunk_invariants(ids_only, articles(t))


@query("i_article_order", r"""
WITH o AS (SELECT p_partkey, p_size, CASE WHEN p_retailprice > 1500 THEN 3 WHEN p_retailprice > 1000 THEN 2 WHEN p_retailprice > 950 THEN 999 ELSE 1 END AS s FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY p_size, s, p_partkey) AS pos FROM o""")
def article_order(t):
    price = F.col("p_retailprice")
    eid = F.concat(F.lit("art_"), F.col("p_size").cast("string"), F.when(price > 1500, "-ter").when(price > 1000, "-bis").when(price > 950, "-zz").otherwise(""))
    keyed = t.part.select("p_partkey", article_sort_key(eid).alias("k")).select("p_partkey", "k.number", "k.suffix_pos")
    return row_positions(keyed, [], ["number", "suffix_pos", "p_partkey"]).select("p_partkey", "pos")


_MARKS = STRIP % f"regexp_replace({STRIP % 'c'}, '[(][(]|[)][)]', '', 'g')"


@query("i_clean_heading", f"""WITH r AS (SELECT doc_id, '(( (' || string_split(text, chr(10))[1] || '). ))' AS c FROM documents),
a AS (SELECT doc_id, {STRIP % f"regexp_replace({_MARKS}, '[.]+$', '')"} AS s FROM r),
b AS (SELECT doc_id, CASE WHEN regexp_matches(s, '(?s)^[(].*[)]$') THEN {STRIP % "regexp_extract(s, '(?s)^[(](.*)[)]$', 1)"} ELSE s END AS s FROM a)
SELECT doc_id, {STRIP % "regexp_replace(s, '[.]+$', '')"} AS heading FROM b""")
def headings(t):
    raw = F.concat(F.lit("(( ("), F.split("text", "\n")[0], F.lit("). ))"))
    return t.documents.select("doc_id", clean_heading(raw).alias("heading"))


@query("i_excerpt", "SELECT doc_id, CASE WHEN length(text) > 250 THEN substr(text, 1, 250) || '...' ELSE text END AS excerpt FROM documents")
def excerpts(t):
    return t.documents.select("doc_id", excerpt(F.col("text"), 250, "...").alias("excerpt"))


@query("i_roman_numerals", """
SELECT o_orderkey, CAST(o_orderkey % 3999 + 1 AS INTEGER) AS value FROM orders""")
def roman(t):
    # The numeral is spelt digit by digit and read back.
    n = F.col("o_orderkey") % 3999 + 1
    digit = lambda k, one, five, ten: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), ((n / k).cast("long") % 10 + 1).cast("int"))
    text = F.concat(digit(1000, "M", "", ""), digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X"))
    return t.orders.select("o_orderkey", roman_to_int(text).alias("value"))


@query("i_short_name", """SELECT l_suppkey, l_partkey, count(*) AS n, CASE l_suppkey % 7 WHEN 0 THEN 'GDPR' WHEN 1 THEN 'AI Act' WHEN 2 THEN 'Codice Privacy' WHEN 3 THEN 'D.Lgs 231/2001' WHEN 4 THEN 'NIS2' WHEN 5 THEN 'L. 132/2025' ELSE '?' END AS name
FROM lineitem GROUP BY l_suppkey, l_partkey""")
def short_names(t):
    prefixes = F.array(*[F.lit(p) for p in [*ids.SHORT_NAMES, "akn/it/other"]])
    chunk = F.concat(F.element_at(prefixes, (F.col("l_suppkey") % 7 + 1).cast("int")), F.lit("__art_"), F.col("l_partkey").cast("string"))
    named = t.lineitem.select("l_suppkey", "l_partkey", ids.short_name(chunk).alias("name"))
    return named.groupBy("l_suppkey", "l_partkey", "name").agg(F.count(F.lit(1)).alias("n"))
