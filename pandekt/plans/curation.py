"""Gold curation and audits over lines, parts, documents and conversations."""

from pyspark.sql import functions as F

from pandekt.functions.text import count_tokens
from pandekt.operators import curation as cu
from pandekt.operators import evaluation as ev
from pandekt.plans.base import lines
from pandekt.plans.evaluation import gold as eval_gold
from pandekt.plans.registry import query
from pandekt.plans.retrieval import LINE_CHUNKS, line_chunks
from pandekt.plans.sqlbits import NTOK
from pandekt.plans.structure import DOC_LINES, PACKED, RENDERED, articles, doc_chunks

PAIR = "SELECT DISTINCT l_partkey AS qid, l_suppkey AS chunk_id FROM lineitem"
GOLD = f"gold AS ({PAIR} WHERE l_returnflag = 'R' AND l_discount >= 0.09)"
CAND = f"cand AS ({PAIR} WHERE l_linenumber <= 5)"


def candidates(t):
    return t.lineitem.filter("l_linenumber <= 5").select(F.col("l_partkey").alias("qid"), F.col("l_suppkey").alias("chunk_id")).distinct()


@query("h1_apply_gold", f"WITH {GOLD},{CAND} SELECT qid, chunk_id, (qid, chunk_id) IN (SELECT (qid, chunk_id) FROM gold) AS is_gold FROM cand")
def apply_gold(t):
    return cu.apply_gold(candidates(t), eval_gold(t))


@query("h1_stray_gold", f"WITH {GOLD},{CAND} SELECT qid, chunk_id FROM gold EXCEPT SELECT qid, chunk_id FROM cand")
def stray(t):
    return cu.stray_gold(candidates(t), eval_gold(t))


@query("h1_gold_counts", f"WITH {GOLD},{CAND} SELECT c.qid, count(*) AS n_candidates, count(g.qid) AS n_gold FROM cand c LEFT JOIN gold g ON g.qid = c.qid AND g.chunk_id = c.chunk_id GROUP BY c.qid")
def gold_counts(t):
    return cu.gold_counts(apply_gold(t))


@query("h1_overlapping_maps", f"WITH {GOLD} SELECT qid FROM gold INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def overlapping(t):
    return cu.overlapping_maps(eval_gold(t), t.part.filter("p_size < 10").select(F.col("p_partkey").alias("qid")))


def supplier_chunks(t):
    return t.supplier.select(F.col("s_suppkey").alias("chunk_id"), F.array(F.lit("Fornitori"), F.col("s_name")).alias("hierarchy_path"), F.col("s_name").alias("text"))


@query("h2_gold_entries", f"""WITH {GOLD}, j AS (SELECT p_partkey AS qid, p_brand AS use_case, CASE WHEN p_size < 10 THEN 'edge' ELSE 'x' END AS expected, g.chunk_id, s_name FROM part
  LEFT JOIN (SELECT gold.*, s_name FROM gold JOIN supplier ON s_suppkey = chunk_id) g ON g.qid = p_partkey)
SELECT qid, use_case, CASE WHEN chunk_id IS NOT NULL THEN 'positive' WHEN expected = 'edge' THEN 'edge' ELSE 'negative' END AS query_type, chunk_id, 'Fornitori > ' || s_name AS hierarchy, s_name AS text,
  CASE WHEN chunk_id IS NULL THEN '[da completare]' END AS notes FROM j""")
def entries(t):
    q = t.part.select(F.col("p_partkey").alias("qid"), F.col("p_brand").alias("use_case"), F.when(F.col("p_size") < 10, "edge").otherwise("x").alias("expected_kind"))
    return cu.gold_entries(q, eval_gold(t), supplier_chunks(t))


def raw_entries(t):
    """Assistant turns as gold answer records; some miss fields or break rules."""
    c = t.conversations.filter("role = 'assistant'")
    turn = F.col("turn")
    kind = F.when(turn == 1, "positive").when(turn == 3, "negative").when(turn == 5, "edge").otherwise("other")
    gold = F.when(turn == 1, F.when(F.col("conv_id") > 60, F.array().cast("array<struct<chunk_id:string,text:string>>")).otherwise(
        F.array(F.struct(F.lit("a__art_1").alias("chunk_id"), F.when(F.col("conv_id") > 40, F.lit("")).otherwise("text").alias("text"))))).otherwise(
        F.array().cast("array<struct<chunk_id:string,text:string>>"))
    answer = F.when(turn == 3, F.concat("text", F.lit(" [cite:a][cite:b]"))).when(F.length("text") > 600, F.concat("text", F.lit(" [cite:a]"))).otherwise(F.col("text"))
    rec = F.struct(F.lit("q").alias("qid"), F.lit("u").alias("use_case"), kind.alias("query_type"), F.lit("?").alias("question"), gold.alias("gold_chunks"), F.lit("a").alias("gold_answer"),
                   F.lit(True).alias("has_corpus_limit_declaration"), F.when(turn < 5, F.lit(False)).alias("runtime_corpus_limit_observed"), F.lit("r").alias("review_status"),
                   F.lit("n").alias("notes"), F.when(F.col("conv_id") < 5, F.lit(1)).alias("surplus"))
    return c.select(F.col("conv_id").alias("qid"), kind.alias("query_type"), gold.alias("gold_chunks"), (turn > 1).alias("has_corpus_limit_declaration"), answer.alias("gold_answer"), F.to_json(rec).alias("raw"))


@query("h3_schema_checks", r"""WITH e AS (SELECT conv_id AS qid, turn, CASE turn WHEN 1 THEN 'positive' WHEN 3 THEN 'negative' WHEN 5 THEN 'edge' ELSE 'other' END AS kind,
  CASE WHEN turn = 1 AND conv_id <= 60 THEN 1 ELSE 0 END AS n_gold, turn = 1 AND conv_id <= 60 AND conv_id > 40 AS blank,
  CASE WHEN turn = 3 THEN text || ' [cite:a][cite:b]' WHEN length(text) > 600 THEN text || ' [cite:a]' ELSE text END AS a FROM conversations WHERE role = 'assistant'),
n AS (SELECT count(*) AS n, count(*) FILTER (turn >= 5 OR qid < 5) AS f1, count(*) FILTER (kind = 'other') AS f2, count(*) FILTER (kind = 'positive' AND n_gold = 0) AS f3, count(*) FILTER (blank OR (kind = 'positive' AND n_gold = 1 AND FALSE)) AS f4,
  count(*) FILTER (turn > 1 AND NOT regexp_matches(a, '(?is)nicht|pas')) AS f5,
  count(*) FILTER ((kind = 'positive' AND n_gold > 0 AND NOT contains(a, '[cite:')) OR (kind = 'negative' AND n_gold = 0 AND contains(a, '[cite:')) OR contains(a, '][cite:')) AS f6 FROM e)
SELECT unnest(['fields', 'enum', 'gold_present', 'text_filled', 'limit_pattern', 'citations']) AS "check", n - unnest([f1, f2, f3, f4, f5, f6]) AS passed, unnest([f1, f2, f3, f4, f5, f6]) AS failed FROM n
UNION ALL SELECT 'unique', count(*) FILTER (k = 1), count(*) FILTER (k > 1) FROM (SELECT qid, count(*) AS k FROM e GROUP BY qid)""")
def schema_checks(t):
    return cu.schema_checks(raw_entries(t), "raw", lambda a: ev.declares_limit(a, ["nicht", "pas"]), r"\[cite:[^\]\s]+\]")


@query("h3_id_sets", """SELECT conv_id AS qid, 'missing' AS problem FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' EXCEPT SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')
UNION ALL SELECT conv_id, 'unexpected' FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system' EXCEPT SELECT DISTINCT conv_id FROM conversations WHERE role = 'user')""")
def id_sets(t):
    c = t.conversations
    pick = lambda r: c.filter(F.col("role") == r).select(F.col("conv_id").alias("qid")).distinct()
    return cu.id_set_check(pick("system"), pick("user"))


def part_gold(t):
    """Every part asks for the document of its number."""
    return t.part.select(F.col("p_partkey").alias("qid"), F.col("p_partkey").alias("chunk_id"))


@query("h4_populate_payload", "SELECT p_partkey AS qid, p_partkey AS chunk_id, source || ' > ' || lang AS hierarchy, text FROM part LEFT JOIN documents ON doc_id = p_partkey")
def populate(t):
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" > ", "source", "lang").alias("hierarchy"), "text")
    return cu.populate_payload(part_gold(t), docs)


@query("h4_populate_summary", "SELECT count(*) AS required, count(doc_id) AS populated, count(*) - count(doc_id) AS missing FROM part LEFT JOIN documents ON doc_id = p_partkey")
def populate_summary(t):
    return cu.populate_summary(populate(t))


@query("h5_crosstab_stats", """WITH e AS (SELECT d.doc_id AS qid, lang AS kind, CAST(quality AS VARCHAR) AS flag, source, unnest([CASE WHEN n_chars <= 1000 THEN 'v1' ELSE 'v2' END, 'all']) AS subset FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT subset, 'type' AS measure, kind AS key, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT subset, 'flag', coalesce(flag, 'null'), count(*) FROM e GROUP BY ALL
UNION ALL SELECT subset, 'type_x_flag', kind || '/' || coalesce(flag, 'null'), count(*) FROM e GROUP BY ALL UNION ALL SELECT subset, 'n', 'all', count(*) FROM e GROUP BY ALL
UNION ALL SELECT subset, 'norm', source, count(DISTINCT qid) FROM e GROUP BY ALL""")
def crosstab(t):
    d = t.documents.join(t.labels, "doc_id", "left").withColumn("qid", F.col("doc_id"))
    norms = t.documents.select(F.col("doc_id").alias("qid"), F.col("source").alias("norm"))
    return cu.crosstab_stats(d, "lang", "quality", norms, F.when(F.col("n_chars") <= 1000, "v1").otherwise("v2"))


STOP = ["the", "and", "der", "die", "que", "les"]
NORM_WORDS = [("en", "the"), ("fr", "eau"), ("de", "sch"), ("es", "ción")]


def turn_norms(c):
    return F.array_compact(F.array(*[F.when(F.contains(c, F.lit(w)), F.lit(n)) for n, w in NORM_WORDS]))


_W = r"list_filter(list_distinct(regexp_extract_all(lower(%s), '[\p{L}\p{M}\p{N}_''-]+')), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '\d+') AND w NOT IN ('the', 'and', 'der', 'die', 'que', 'les'))"
_N = "list_filter([" + ", ".join(f"CASE WHEN contains(%s, '{w}') THEN '{n}' END" for n, w in NORM_WORDS) + "], lambda x: x IS NOT NULL)"


H6_SQL = f"""
WITH n AS (SELECT 'c' || conv_id || '-' || turn AS qid, {_W % 'text'} AS w, {_N.replace('%s', 'text')} AS norms FROM conversations WHERE role = 'user'),
o AS (SELECT 'b' || item_id AS old_qid, {_W % 'text'} AS ow, {_N.replace('%s', 'text')} AS old_norms FROM benchmark),
p AS (SELECT *, norms = old_norms AND len(norms) > 0 AS same, list_has_any(norms, old_norms) AS ov FROM n CROSS JOIN o),
l AS (SELECT qid, CASE WHEN bool_or(same) THEN 0 WHEN bool_or(ov) THEN 1 ELSE 2 END AS pool FROM p GROUP BY qid),
j AS (SELECT qid, old_qid, round(len(list_intersect(w, ow)) / (len(w) + len(ow) - len(list_intersect(w, ow))), 9) AS jac, list_sort(list_intersect(w, ow)) AS shared FROM p JOIN l USING (qid)
  WHERE CASE pool WHEN 0 THEN same WHEN 1 THEN ov AND NOT same ELSE FALSE END),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY jac DESC, old_qid) AS r FROM j WHERE jac > 0) WHERE r = 1)
SELECT l.qid, old_qid, coalesce(jac, 0.0) AS jaccard, CASE WHEN pool = 2 THEN 'new_area' WHEN coalesce(jac, 0) >= 0.4 THEN 'high' WHEN coalesce(jac, 0) >= 0.2 THEN 'some' ELSE 'distinct' END AS flag, coalesce(array_to_string(shared, ','), '') AS shared
FROM l LEFT JOIN b USING (qid)"""


def overlap_sides(t):
    n = t.conversations.filter("role = 'user'").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"), "text", turn_norms(F.col("text")).alias("norms"))
    o = t.benchmark.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), "text", turn_norms(F.col("text")).alias("norms"))
    return n, o


@query("h6_best_overlap", H6_SQL)
def overlap(t):
    return cu.best_overlap(*overlap_sides(t), STOP).withColumn("shared", F.array_join("shared", ","))


@query("h6_default_stopwords", H6_SQL.replace("('the', 'and', 'der', 'die', 'que', 'les')", "(" + ", ".join(f"'{w}'" for w in cu.STOPWORDS) + ")"))
def overlap_default(t):
    return cu.best_overlap(*overlap_sides(t)).withColumn("shared", F.array_join("shared", ","))


@query("h7_rewrite_ids", """
WITH l AS (SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p, l_suppkey AS c FROM lineitem),
m AS (SELECT s_suppkey AS c, 0 AS np, s_suppkey * 1000 AS ni FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_suppkey, 1, s_suppkey * 1000 + 1 FROM supplier WHERE s_acctbal < 0 AND s_nationkey > 10)
SELECT qid, coalesce(ni, c) AS chunk_id, ni IS NOT NULL AS rewritten, row_number() OVER (PARTITION BY qid ORDER BY p, coalesce(np, 0)) AS pos FROM l LEFT JOIN m USING (c)""")
def rewrite(t):
    from pandekt.operators.ordered import row_positions
    l = row_positions(t.lineitem.select(F.col("l_orderkey").alias("qid"), "l_linenumber", "l_partkey", F.col("l_suppkey").alias("chunk_id"), "l_quantity"),
                      ["qid"], ["l_linenumber", "l_partkey", "chunk_id", "l_quantity"]).select("qid", "pos", "chunk_id")
    s = t.supplier.filter("s_acctbal < 0")
    n = F.when(F.col("s_nationkey") > 10, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    m = s.select(F.col("s_suppkey").alias("chunk_id"), F.explode(n).alias("new_pos")).withColumn("new_id", F.col("chunk_id") * 1000 + F.col("new_pos"))
    return cu.rewrite_ids(l, m).select("qid", "chunk_id", "rewritten", "pos")


def mixed_ids(t):
    """Article, recital and annex ids under supplier laws."""
    k = F.col("p_partkey").cast("string")
    annex = t.part.select(F.concat(F.col("p_brand"), F.lit("__annex_"), F.when(F.col("p_size") > 25, F.concat(F.lit("III__point_"), k)).otherwise(F.lit("III"))).alias("chunk_id"))
    rec = t.conversations.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit("__recital_"), F.col("turn").cast("string")).alias("chunk_id"))
    other = t.nation.select(F.col("n_name").alias("chunk_id"))
    return line_chunks(t).unionByName(annex).unionByName(rec).unionByName(other)


MIXED = LINE_CHUNKS + """,
mx AS (SELECT chunk_id FROM lc UNION ALL SELECT p_brand || '__annex_' || CASE WHEN p_size > 25 THEN 'III__point_' || p_partkey ELSE 'III' END FROM part
  UNION ALL SELECT 'conv' || conv_id || '__recital_' || turn FROM conversations UNION ALL SELECT n_name FROM nation)"""


@query("h8_inventory", f"""WITH {MIXED},
u AS (SELECT split_part(chunk_id, '__', 1) AS norm, CASE WHEN contains(chunk_id, '__art_') AND contains(chunk_id, '__paras_') THEN 'article_fragment' WHEN contains(chunk_id, '__art_') THEN 'article' WHEN contains(chunk_id, '__recital_') THEN 'recital'
  WHEN contains(chunk_id, '__annex_') AND contains(chunk_id, '__point_') THEN 'annex_point' WHEN contains(chunk_id, '__annex_') THEN 'annex' ELSE 'other' END AS unit, regexp_replace(chunk_id, '__paras_.*$', '') AS b FROM mx)
SELECT norm, count(*) FILTER (unit = 'article') AS article, count(*) FILTER (unit = 'article_fragment') AS article_fragment, count(*) FILTER (unit = 'recital') AS recital, count(*) FILTER (unit = 'annex') AS annex,
  count(*) FILTER (unit = 'annex_point') AS annex_point, count(*) FILTER (unit = 'other') AS other, count(DISTINCT b) AS n_base_ids FROM u GROUP BY norm""")
def inventory(t):
    return cu.inventory(mixed_ids(t))


def supplier_units(t, cond):
    return t.lineitem.filter(cond).select(F.col("l_suppkey").alias("norm"), F.col("l_partkey").alias("unit"))


def gaps(t):
    """Expected: lines of finished status; actual: lines of open status; repealed: returned ones."""
    return cu.gap_analysis(supplier_units(t, "l_linestatus = 'F'"), supplier_units(t, "l_linestatus = 'O'"), supplier_units(t, "l_returnflag = 'R'"))


GAPS = """
g AS (SELECT l_suppkey AS norm, l_partkey AS unit, bool_or(l_linestatus = 'F') AS e, bool_or(l_linestatus = 'O') AS a, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL),
gaps AS (SELECT norm, unit, CASE WHEN NOT a THEN 'missing' WHEN NOT e THEN 'unexpected' ELSE 'both' END AS status, CASE WHEN NOT a THEN CASE WHEN r THEN 'repealed' ELSE 'to_investigate' END END AS cause FROM g WHERE e OR a)"""


@query("h9_gap_analysis", f"WITH {GAPS} SELECT * FROM gaps")
def gap_rows(t):
    return gaps(t)


@query("h9_gap_summary", f"""WITH {GAPS} SELECT norm, count(*) FILTER (status <> 'unexpected') AS n_expected, count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status = 'unexpected') AS n_unexpected,
  coalesce(round(count(*) FILTER (status = 'missing') / nullif(count(*) FILTER (status <> 'unexpected'), 0) * 100, 6), 0.0) AS missing_pct FROM gaps GROUP BY norm""")
def gap_summary(t):
    return cu.gap_summary(gaps(t))


@query("h10_gap_impact", f"""WITH {GAPS}, q AS (SELECT DISTINCT l_orderkey AS qid, l_suppkey AS norm, l_partkey AS unit FROM lineitem WHERE l_discount >= 0.1),
h AS (SELECT norm, count(DISTINCT qid) AS n FROM q JOIN gaps USING (norm, unit) WHERE status = 'missing' GROUP BY norm)
SELECT gaps.norm, count(*) FILTER (status = 'missing') AS n_gap, coalesce(any_value(h.n), 0) AS n_impacted, CASE WHEN count(*) FILTER (status = 'missing') = 0 THEN 'none' WHEN coalesce(any_value(h.n), 0) > 0 THEN 'high' ELSE 'medium' END AS priority
FROM gaps LEFT JOIN h ON h.norm = gaps.norm GROUP BY gaps.norm""")
def gap_impact(t):
    g = t.lineitem.filter("l_discount >= 0.1").select(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("norm"), F.col("l_partkey").alias("unit"))
    return cu.gap_impact(gaps(t), g)


@query("h11_reconcile_counts", """WITH a AS (SELECT source AS doc, count(*) AS actual FROM documents GROUP BY source), e AS (SELECT 'src' || n_nationkey AS doc, CAST(n_regionkey * 25 AS BIGINT) AS expected FROM nation WHERE n_nationkey > 2)
SELECT coalesce(a.doc, e.doc) AS doc, coalesce(actual, 0) AS actual, coalesce(expected, 0) AS expected, coalesce(actual, 0) = coalesce(expected, 0) AS ok FROM a FULL JOIN e ON a.doc = e.doc""")
def reconcile(t):
    e = t.nation.filter("n_nationkey > 2").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("doc"), (F.col("n_regionkey") * 25).cast("long").alias("expected"))
    return cu.reconcile_counts(t.documents.select(F.col("source").alias("doc")), e, "doc")


@query("h12_id_format_check", rf"WITH {MIXED} SELECT chunk_id FROM mx WHERE NOT regexp_matches(chunk_id, '^[a-z0-9/_.:\-]+__(art_\d+[a-z0-9.\-]*(__paras_\w+_\w+)?|recital_\d+|annex_[IVXLC]+(__point_\d+)?)$')")
def formats(t):
    return cu.malformed_ids(mixed_ids(t))


@query("h13_gold_exists", f"""WITH {LINE_CHUNKS} SELECT DISTINCT 'doc' || l_suppkey || '__art_' || l_partkey AS chunk_id FROM lineitem WHERE 'doc' || l_suppkey || '__art_' || l_partkey NOT IN (SELECT chunk_id FROM lc)""")
def gold_exists(t):
    g = t.lineitem.select(F.concat(F.lit("doc"), F.col("l_suppkey").cast("string"), F.lit("__art_"), F.col("l_partkey").cast("string")).alias("chunk_id"))
    return cu.missing_gold(g, line_chunks(t))


# Proposals: every order proposes ids for its lines, spelled in several ways.
PROPOSED = LINE_CHUNKS + """,
pr AS (SELECT l_orderkey AS qid, o_orderpriority AS cluster, CASE WHEN l_tax = 0.08 THEN 'old' || l_suppkey ELSE 'doc' || l_suppkey END || '__' ||
  CASE WHEN l_linenumber = 7 THEN 'annex_IV' WHEN l_linenumber = 6 THEN 'art_' || l_partkey || '_par_1' WHEN l_linenumber = 5 THEN 'art_' || (l_partkey + 1500) ELSE 'art_' || l_partkey END AS chunk_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
miss AS (SELECT DISTINCT qid, cluster, chunk_id FROM pr WHERE chunk_id NOT IN (SELECT chunk_id FROM lc))"""


def proposals(t):
    supp, part, n = F.col("l_suppkey").cast("string"), F.col("l_partkey"), F.col("l_linenumber")
    unit = (F.when(n == 7, "annex_IV").when(n == 6, F.concat(F.lit("art_"), part.cast("string"), F.lit("_par_1")))
            .when(n == 5, F.concat(F.lit("art_"), (part + 1500).cast("string"))).otherwise(F.concat(F.lit("art_"), part.cast("string"))))
    law = F.concat(F.when(F.col("l_tax") == 0.08, "old").otherwise("doc"), supp)
    l = t.lineitem.select(F.col("l_orderkey").alias("qid"), F.concat_ws("__", law, unit).alias("chunk_id"))
    return l.join(t.orders.select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("cluster")), "qid")


AUDIT = PROPOSED + """,
au AS (SELECT qid, cluster, count(*) AS proposed, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM lc)) AS existing, count(*) FILTER (chunk_id NOT IN (SELECT chunk_id FROM lc)) AS gap FROM pr GROUP BY ALL)"""


@query("h14_audit_candidates", f"WITH {AUDIT} SELECT * FROM au")
def audit(t):
    return cu.audit_candidates(proposals(t), line_chunks(t))


@query("h14_cluster_audit", f"""WITH {AUDIT} SELECT cluster, count(*) FILTER (gap = 0) AS n_pass, count(*) FILTER (gap > 0) AS n_fail, round(count(*) FILTER (gap = 0) / count(*) * 100, 4) AS pass_pct,
  round(count(*) FILTER (gap = 0) / count(*) * 100, 4) < 70 AS flagged FROM au GROUP BY cluster""")
def cluster_audit(t):
    return cu.cluster_audit(audit(t))


@query("h14_often_missing", f"WITH {PROPOSED} SELECT chunk_id, count(*) AS n_queries FROM miss GROUP BY chunk_id HAVING count(*) >= 3")
def often(t):
    return cu.often_missing(cu.missing_proposals(proposals(t), line_chunks(t)))


WRONG = {"old1": "doc1", "old2": "doc2", "old3": "doc3"}


def laws(t):
    return t.supplier.select(F.concat(F.lit("doc"), F.col("s_suppkey").cast("string")).alias("norm"), F.lit(2000).alias("max_article"),
                             (F.col("s_nationkey") > 12).alias("annexes_loaded"), (F.col("s_acctbal") < 0).alias("repealed_excluded"))


CAUSES = PROPOSED + r""",
laws AS (SELECT 'doc' || s_suppkey AS norm, 2000 AS max_article, s_nationkey > 12 AS annexes_loaded, s_acctbal < 0 AS repealed_excluded FROM supplier),
ids AS (SELECT DISTINCT chunk_id, split_part(chunk_id, '__', 1) AS norm, substr(chunk_id, length(split_part(chunk_id, '__', 1)) + 3) AS suffix FROM miss),
kids AS (SELECT DISTINCT regexp_replace(chunk_id, '__paras_.*$', '') AS chunk_id FROM lc WHERE contains(chunk_id, '__paras_')),
ca AS (SELECT ids.*, k.chunk_id IS NOT NULL AS has_fragments, CASE WHEN norm IN ('old1', 'old2', 'old3') OR max_article IS NULL THEN 'c' WHEN regexp_matches(suffix, '^art_\d+[a-z\-]*_par_\d+') THEN 'd'
  WHEN starts_with(suffix, 'annex_') AND NOT annexes_loaded THEN 'e' WHEN starts_with(suffix, 'art_') AND repealed_excluded THEN 'b' WHEN TRY_CAST(regexp_extract(suffix, '^art_(\d+)', 1) AS INTEGER) > max_article THEN 'a'
  WHEN k.chunk_id IS NOT NULL THEN 'd' ELSE 'f' END AS cause FROM ids LEFT JOIN laws USING (norm) LEFT JOIN kids k USING (chunk_id)),
tg AS (SELECT *, CASE WHEN cause = 'c' AND starts_with(norm, 'old') AND norm IN ('old1', 'old2', 'old3') THEN 'doc' || substr(norm, 4) || '__' || suffix WHEN cause = 'd' AND NOT has_fragments THEN regexp_replace(chunk_id, '_par_\d+.*$', '') END AS target FROM ca),
rp AS (SELECT tg.chunk_id, cause, CASE WHEN (has_fragments AND cause = 'd') OR lc.chunk_id IS NOT NULL THEN 'repair' WHEN cause = 'c' AND norm IN ('old1', 'old2', 'old3') THEN 'discard' WHEN cause IN ('a', 'b', 'e') THEN 'discard' WHEN cause = 'c' THEN NULL ELSE 'replace' END AS action,
  CASE WHEN lc.chunk_id IS NOT NULL THEN target END AS proposal FROM tg LEFT JOIN lc ON lc.chunk_id = target),
qa AS (SELECT qid, cluster, CASE WHEN bool_or(coalesce(action = 'repair', FALSE)) AND NOT bool_or(coalesce(action = 'discard', FALSE)) THEN 'repair'
  WHEN bool_or(coalesce(action = 'discard', FALSE)) AND NOT bool_or(coalesce(action = 'repair', FALSE)) AND NOT bool_or(coalesce(action = 'replace', FALSE)) THEN 'discard' ELSE 'replace' END AS action FROM miss JOIN rp USING (chunk_id) GROUP BY ALL)"""


def causes(t):
    return cu.classify_missing(cu.missing_proposals(proposals(t), line_chunks(t)), line_chunks(t), laws(t), WRONG)


@query("h15_classify_missing", f"WITH {CAUSES} SELECT chunk_id, norm, suffix, has_fragments, cause FROM ca")
def classify(t):
    return causes(t)


@query("h16_suggest_repair", f"WITH {CAUSES} SELECT chunk_id, cause, action, proposal FROM rp")
def repair(t):
    return cu.suggest_repair(causes(t), line_chunks(t), WRONG)


@query("h16_query_actions", f"WITH {CAUSES} SELECT * FROM qa")
def actions(t):
    return cu.query_actions(cu.missing_proposals(proposals(t), line_chunks(t)), repair(t))


@query("h16_survivors", f"""WITH {CAUSES}, au AS (SELECT qid, cluster, count(*) FILTER (chunk_id NOT IN (SELECT chunk_id FROM lc)) AS gap FROM pr GROUP BY ALL),
tg2 AS (SELECT o_orderpriority AS cluster, CAST(count(*) // 2 AS BIGINT) AS target FROM orders GROUP BY ALL),
s AS (SELECT au.cluster, count(*) AS n FROM au LEFT JOIN qa ON qa.qid = au.qid WHERE gap = 0 OR action IN ('repair', 'replace') GROUP BY au.cluster)
SELECT cluster, target, coalesce(n, 0) AS survivors, round(coalesce(n, 0) / target, 4) AS ratio, CASE WHEN round(coalesce(n, 0) / target, 4) < 1 THEN 'under_target' WHEN round(coalesce(n, 0) / target, 4) < 1.5 THEN 'at_risk' ELSE '' END AS alert FROM tg2 LEFT JOIN s USING (cluster)""")
def survive(t):
    targets = t.orders.groupBy(F.col("o_orderpriority").alias("cluster")).agg(F.floor(F.count(F.lit(1)) / 2).alias("target"))
    return cu.survivors(audit(t), actions(t), targets)


# --------------------------------------------------------------- statistics


def doc_tokens(t):
    return t.documents.select("doc_id", "source", count_tokens(F.col("text")).alias("tokens"))


@query("h17_corpus_stats", f"""WITH k AS (SELECT source, CAST({NTOK % 'text'} AS INTEGER) AS t FROM documents), s AS (SELECT source, list_sort(list(t)) AS s FROM k GROUP BY source)
SELECT source, CAST(len(s) AS BIGINT) AS n, s[CAST(round_even(0.5 * (len(s) - 1), 0) AS BIGINT) + 1] AS p50, s[CAST(round_even(0.9 * (len(s) - 1), 0) AS BIGINT) + 1] AS p90, s[CAST(round_even(0.99 * (len(s) - 1), 0) AS BIGINT) + 1] AS p99, s[len(s)] AS max,
  CAST(len(list_filter(s, lambda x: x > 1000)) AS BIGINT) AS over_1000, CAST(len(list_filter(s, lambda x: x > 2000)) AS BIGINT) AS over_2000, CAST(len(list_filter(s, lambda x: x > 4000)) AS BIGINT) AS over_4000 FROM s""")
def stats(t):
    return cu.corpus_stats(doc_tokens(t), "source", "tokens")


@query("h17_longest", f"""SELECT doc_id, source, CAST({NTOK % 'text'} AS INTEGER) AS tokens, row_number() OVER (PARTITION BY source ORDER BY {NTOK % 'text'} DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5""")
def longest(t):
    return cu.longest(doc_tokens(t), "source", "doc_id", "tokens")


LONG = 300


@query("h18_long_articles", rf"""WITH {DOC_LINES}, k AS (SELECT doc_id, list_sort(list(CAST({NTOK % 'line'} AS INTEGER))) AS s FROM dl GROUP BY doc_id), d AS (SELECT doc_id, source, replace(text, ' the ', ' a) ') AS text, CAST({NTOK % "replace(text, ' the ', ' a) ')"} AS INTEGER) AS tokens FROM documents)
SELECT source AS doc, doc_id AS article_id, tokens, CAST(len(s) AS INTEGER) AS n_paragraphs, s[CAST(round_even(0.5 * (len(s) - 1), 0) AS BIGINT) + 1] AS p50, s[CAST(round_even(0.9 * (len(s) - 1), 0) AS BIGINT) + 1] AS p90, s[CAST(round_even(0.99 * (len(s) - 1), 0) AS BIGINT) + 1] AS p99, s[len(s)] AS max,
  len(list_distinct(list_transform(regexp_extract_all(text, '(?i)(?:^|[\s\(])([a-z])\)\s', 1), lambda x: lower(x)))) >= 2 AS has_letters, FALSE AS is_monoblock FROM d JOIN k USING (doc_id) WHERE tokens > {LONG}""")
def long_articles(t):
    a = t.documents.select(F.col("source").alias("doc"), F.col("doc_id").alias("article_id"), F.replace("text", F.lit(" the "), F.lit(" a) ")).alias("text"), lines(F.col("text")).alias("paragraphs"))
    return cu.long_articles(a, count_tokens, LONG)


def line_gold(t):
    """Gold of every order: its lines under supplier nations as laws."""
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("qid"), F.col("s_nationkey").alias("norm"),
        F.concat(F.lit("doc"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") > 4, "__recital_").otherwise("__art_"), F.col("l_partkey").cast("string")).alias("chunk_id"))


LG = "lg AS (SELECT l_orderkey AS qid, s_nationkey AS norm, 'doc' || l_suppkey || CASE WHEN l_linenumber > 4 THEN '__recital_' ELSE '__art_' END || l_partkey AS chunk_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"


@query("h19_norm_distribution", f"WITH {LG} SELECT norm, count(DISTINCT qid) AS n_queries, round(count(DISTINCT qid) / (SELECT count(*) FROM orders) * 100, 4) AS pct FROM lg GROUP BY norm")
def norms(t):
    return cu.norm_distribution(line_gold(t), t.orders.agg(F.count(F.lit(1))))


@query("h19_norm_breadth", f"WITH {LG} SELECT CASE n WHEN 1 THEN 'mono' WHEN 2 THEN 'two' ELSE 'three_plus' END AS breadth, count(*) AS n FROM (SELECT qid, least(count(DISTINCT norm), 3) AS n FROM lg GROUP BY qid) GROUP BY 1")
def breadth(t):
    return cu.norm_breadth(line_gold(t))


@query("h19_unit_distribution", f"WITH {LG} SELECT CASE WHEN contains(chunk_id, '__art_') THEN 'article' ELSE 'recital' END AS unit, count(*) AS n_chunks, count(DISTINCT qid) AS n_queries FROM lg GROUP BY 1")
def unit_dist(t):
    return cu.unit_distribution(line_gold(t))


@query("h20_rule_classify", """
WITH d AS (SELECT d.doc_id, source AS uc, replace(replace(lower(text), 'the', 'gdpr'), 'que', 'quando') AS q, coalesce(quality, 0) + coalesce(toxic, 0) + 1 AS nn FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT *, CASE WHEN question_type = 'Altro' THEN 'fallback: non classificata da nessuna euristica' ELSE '' END AS note FROM (SELECT doc_id, CASE WHEN contains(uc || ' ' || q, '231') THEN 'UC3 — 231 responsabilità ente' WHEN contains(q, 'nis2') THEN 'UC5 — NIS2 / cybersecurity' WHEN contains(q, 'ai act') OR contains(q, 'fria') OR contains(q, 'gpai') OR contains(q, 'art 11') THEN 'UC2 — AI Act' WHEN contains(q, 'gdpr') OR contains(q, 'dpo') THEN 'UC1 — GDPR compliance' ELSE '?' END AS use_case,
  CASE WHEN contains(q, 'pena') OR contains(q, 'multa') THEN 'Sanzionatorio' WHEN (nn >= 3 OR (contains(q, 'uso') AND contains(q, 'ai'))) AND nn >= 2 THEN 'Cross-norma scenario' WHEN contains(substr(q, 1, 20), 'art ') THEN 'Lookup definitorio' WHEN starts_with(q, 'come ') OR contains(q, 'come si') THEN 'Procedurale' WHEN contains(q, 'quando') THEN 'Condizionale' ELSE 'Altro' END AS question_type FROM d)""")
def rules(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    q = F.replace(F.replace(F.lower("text"), F.lit("the"), F.lit("gdpr")), F.lit("que"), F.lit("quando"))
    n = F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0)) + 1
    return d.select("doc_id", cu.use_case_of(F.col("source"), q).alias("use_case"), cu.question_type_of(F.col("source"), q, n).alias("question_type")).withColumn("note", cu.type_note(F.col("question_type")))


@query("h21_gold_sampling", f"""WITH {LINE_CHUNKS}, g AS (SELECT DISTINCT regexp_replace(chunk_id, '__paras_.*$', '') AS article, split_part(chunk_id, '__art_', 2) AS q, chunk_id FROM lc WHERE split_part(chunk_id, '__', 1) = (SELECT 'doc' || max(s_suppkey) FROM supplier))
SELECT article, qid, n_gold FROM (SELECT DISTINCT article, split_part(q, '__', 1) AS qid FROM g) JOIN (SELECT article, count(*) AS n_gold FROM g GROUP BY article) USING (article)""")
def sampling(t):
    c = line_chunks(t)
    g = c.select(F.regexp_extract("chunk_id", r"__art_(\d+)", 1).alias("qid"), F.substring_index("chunk_id", "__", 1).alias("doc_urn"), "chunk_id")
    law = t.supplier.agg(F.concat(F.lit("doc"), F.max("s_suppkey").cast("string"))).scalar()
    return cu.gold_sampling(g, law)


@query("h22_article_integrity", f"""WITH RECURSIVE {DOC_LINES},{RENDERED},{PACKED},
w AS (SELECT 'art_' || p_partkey AS article_eid, p_partkey AS k FROM part), a AS (SELECT doc_id, lang || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS body, len(string_split(text, chr(10))) AS np FROM documents),
c AS (SELECT CAST(regexp_extract(chunk_id, '__art_(\\d+)', 1) AS BIGINT) AS k, count(*) AS n, string_agg(DISTINCT chunk_type, ',' ORDER BY chunk_type) AS ct, count(*) FILTER (oversize) AS o FROM chunks GROUP BY 1)
SELECT article_eid, a.doc_id IS NOT NULL AS present, coalesce(trim(body) <> '', FALSE) AS non_empty, CAST(coalesce(np, 0) AS INTEGER) AS n_paragraphs, CAST(coalesce(length(body), 0) AS INTEGER) AS n_chars, coalesce(length(body) // 4 > 500, FALSE) AS oversize_estimate,
  coalesce(c.n, 0) AS n_chunks, c.ct AS chunk_types, CASE WHEN c.n IS NULL THEN 'not_chunked' WHEN o > 0 THEN 'oversize' ELSE 'ok' END AS warning FROM w LEFT JOIN a ON a.doc_id = w.k LEFT JOIN c ON c.k = w.k""")
def integrity(t):
    wanted = t.part.select(F.concat(F.lit("art_"), F.col("p_partkey").cast("string")).alias("article_eid"))
    a = articles(t).select("article_eid", F.col("rubrica").alias("title"), F.transform("paragraphs", lambda p: p["text"]).alias("paragraphs"))
    c = doc_chunks(t).select("article_eid", "chunk_type", "metadata.oversize")
    return cu.article_integrity(wanted, a, c, 500)
