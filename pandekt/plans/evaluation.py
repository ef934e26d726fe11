"""Retrieval evaluation over hits derived from lineitem.

Roles: part = question, its suppliers = retrieved chunks under three setups
(different scores over the same lines), discounted returned lines = gold,
brand = use case, container size = named cluster, events = timing log.
"""

from pyspark.sql import functions as F

from pandekt.operators import evaluation as ev
from pandekt.operators import quantiles as qt
from pandekt.operators.ordered import top_k
from pandekt.plans.registry import query

SETUPS = ["dense", "hybrid", "rerank"]


def hits(t):
    best = t.lineitem.groupBy(F.col("l_partkey").alias("qid"), F.col("l_suppkey").alias("chunk_id")).agg(
        F.max("l_extendedprice").alias("dense"), F.sum("l_quantity").alias("hybrid"),
        F.round(F.max(F.col("l_discount") * 10 + F.col("l_tax")), 4).alias("rerank"))
    long = best.unpivot(["qid", "chunk_id"], SETUPS, "setup", "score")
    return top_k(long, ["qid", "setup"], [F.desc("score"), F.asc("chunk_id")], 50).select("qid", "setup", "rank", "chunk_id", "score")


def gold(t):
    l = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09))
    return l.select(F.col("l_partkey").alias("qid"), F.col("l_suppkey").alias("chunk_id")).distinct()


def parts(t):
    return t.part.select(F.col("p_partkey").alias("qid"), F.col("p_brand").alias("use_case"), "p_size", "p_type", "p_retailprice")


def metrics(t, only: str | None = None):
    g = gold(t)
    return ev.query_metrics(parts(t), g, hits(t), SETUPS)


HITS = """
hb AS (SELECT l_partkey AS qid, l_suppkey AS chunk_id, max(l_extendedprice) AS dense, sum(l_quantity) AS hybrid, round(max(l_discount * 10 + l_tax), 4) AS rerank FROM lineitem GROUP BY ALL),
hl AS (SELECT qid, chunk_id, 'dense' AS setup, dense AS score FROM hb UNION ALL SELECT qid, chunk_id, 'hybrid', hybrid FROM hb UNION ALL SELECT qid, chunk_id, 'rerank', rerank FROM hb),
hits AS (SELECT qid, setup, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, setup ORDER BY score DESC, chunk_id) AS rank FROM hl) WHERE rank <= 50),
gold AS (SELECT DISTINCT l_partkey AS qid, l_suppkey AS chunk_id FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09),
parts AS (SELECT p_partkey AS qid, p_brand AS use_case, p_size, p_type, p_retailprice FROM part)"""

METRICS = HITS + """,
gr AS (SELECT g.qid, s.setup, g.chunk_id, h.rank FROM gold g CROSS JOIN (SELECT unnest(['dense', 'hybrid', 'rerank']) AS setup) s
  LEFT JOIN hits h ON h.qid = g.qid AND h.setup = s.setup AND h.chunk_id = g.chunk_id),
gm AS (SELECT qid, setup, count(*) AS n_gold, round(count(*) FILTER (rank <= 5) / count(*), 9) AS r5, round(count(*) FILTER (rank <= 10) / count(*), 9) AS r10,
  round(count(*) FILTER (rank <= 20) / count(*), 9) AS r20, round(coalesce(1.0 / min(rank) FILTER (rank <= 10), 0), 9) AS mrr,
  round(coalesce(sum(1.0 / log2(rank + 1)) FILTER (rank <= 10), 0) / list_sum(list_transform(range(1, CAST(least(10, count(*)) AS BIGINT) + 1), lambda i: 1.0 / log2(i + 1))), 9) AS ndcg,
  min(rank) AS first_gold_rank FROM gr GROUP BY qid, setup),
metrics AS (SELECT p.qid, s.setup, coalesce(n_gold, 0) AS n_gold, r5, r10, r20, mrr, ndcg, first_gold_rank FROM parts p
  CROSS JOIN (SELECT unnest(['dense', 'hybrid', 'rerank']) AS setup) s LEFT JOIN gm ON gm.qid = p.qid AND gm.setup = s.setup)"""


@query("g1_recall_at_k", f"WITH {METRICS} SELECT qid, setup, r5, r10, r20 FROM metrics")
def recall(t):
    return metrics(t).select("qid", "setup", "r5", "r10", "r20")


@query("g1_recall_empty_zero", f"WITH {METRICS} SELECT qid, setup, coalesce(r10, 0.0) AS r10 FROM metrics")
def recall_zero(t):
    return ev.query_metrics(parts(t), gold(t), hits(t), SETUPS, empty=0.0).select("qid", "setup", "r10")


@query("g2_mrr_at_k", f"""WITH {METRICS}, m20 AS (SELECT qid, setup, round(coalesce(1.0 / min(rank) FILTER (rank <= 20), 0), 9) AS mrr20 FROM gr GROUP BY ALL)
SELECT m.qid, m.setup, mrr, mrr20 FROM metrics m LEFT JOIN m20 USING (qid, setup)""")
def mrr(t):
    wide = ev.query_metrics(parts(t), gold(t), hits(t), SETUPS, mrr_window=20).select("qid", "setup", F.col("mrr").alias("mrr20"))
    return metrics(t).select("qid", "setup", "mrr").join(wide, ["qid", "setup"])


@query("g3_ndcg_at_k", f"WITH {METRICS} SELECT qid, setup, ndcg FROM metrics")
def ndcg(t):
    return metrics(t).select("qid", "setup", "ndcg")


@query("g4_first_gold_rank", f"WITH {METRICS} SELECT qid, setup, n_gold, first_gold_rank FROM metrics")
def first_rank(t):
    return metrics(t).select("qid", "setup", "n_gold", "first_gold_rank")


MEANS = "round(avg(r5), 6) AS r5, round(avg(r10), 6) AS r10, round(avg(r20), 6) AS r20, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg"


@query("g5_setup_means", f"WITH {METRICS} SELECT setup, count(*) FILTER (n_gold > 0) AS n_positive, count(*) FILTER (n_gold = 0) AS n_empty, {MEANS} FROM metrics GROUP BY setup")
def setup_means(t):
    return ev.setup_means(metrics(t))


@query("g6_grouped_means", f"""WITH {METRICS},
per AS (SELECT use_case, setup, count(*) AS n, {MEANS} FROM metrics JOIN parts USING (qid) WHERE n_gold > 0 GROUP BY ALL)
SELECT u.use_case, s.setup, coalesce(n, 0) AS n, r5, r10, r20, mrr, ndcg FROM (SELECT DISTINCT use_case FROM parts) u
  CROSS JOIN (SELECT unnest(['dense', 'hybrid', 'rerank']) AS setup) s LEFT JOIN per ON per.use_case = u.use_case AND per.setup = s.setup""")
def grouped_means(t):
    return ev.grouped_means(metrics(t), parts(t), "use_case", SETUPS)


@query("g6_cluster_means", f"""WITH {METRICS},
cl AS (SELECT qid, 'small' AS cluster FROM parts WHERE p_size <= 20 UNION ALL SELECT qid, 'cheap' FROM parts WHERE p_retailprice < 1500 UNION ALL SELECT qid, 'all' FROM parts)
SELECT cluster, setup, count(*) AS n, {MEANS} FROM metrics JOIN cl USING (qid) WHERE n_gold > 0 GROUP BY ALL""")
def cluster_means(t):
    p = parts(t)
    member = p.select("qid", F.explode(F.array_compact(F.array(
        F.when(F.col("p_size") <= 20, "small"), F.when(F.col("p_retailprice") < 1500, "cheap"), F.lit("all")))).alias("cluster"))
    return ev.grouped_means(metrics(t), member, "cluster", SETUPS)


# -------------------------------------------------------- score statistics


def describe_sql(key: str, source: str, value: str) -> str:
    """Reference statement of the statistics block, by position in the sorted list."""
    return f"""SELECT {key}, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, min(v) AS min, max(v) AS max, round(stddev_pop(v), 6) AS std,
  s[CAST(greatest(0, floor(0.10 * len(s)) - 1) AS BIGINT) + 1] AS p10, s[CAST(least(len(s) - 1, floor(0.90 * len(s))) AS BIGINT) + 1] AS p90
  FROM (SELECT *, list_sort(list(v) FILTER (v IS NOT NULL) OVER (PARTITION BY {key})) AS s FROM (SELECT {key}, CAST({value} AS DOUBLE) AS v FROM {source})) GROUP BY {key}, s"""


def rounded(df, names=("mean", "median", "std")):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


def doc_scores(t):
    """Documents with their labels; the length stands for a score, unlabelled ones have none."""
    d = t.documents.join(t.labels, "doc_id", "left")
    return d.select("doc_id", "lang", "source", F.col("quality").alias("flag"), F.col("toxic").alias("kind"),
                    F.when(F.col("quality").isNotNull(), F.col("n_chars") / 100.0).alias("score"))


DOC_SCORES = """ds AS (SELECT d.doc_id, lang, source, quality AS flag, toxic AS kind, CASE WHEN quality IS NOT NULL THEN n_chars / 100.0 END AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query("g7_describe_scores", f"WITH {DOC_SCORES} {describe_sql('source', 'ds', 'score')}")
def describe(t):
    return rounded(qt.describe(doc_scores(t), ["source"], "score"))


@query("g8_breakdowns", f"""WITH {DOC_SCORES}, flat AS (SELECT 'all' AS dimension, 'all' AS member, score FROM ds UNION ALL SELECT 'lang', lang, score FROM ds
  UNION ALL SELECT 'flag', CAST(flag AS VARCHAR), score FROM ds UNION ALL SELECT 'kind', CAST(kind AS VARCHAR), score FROM ds UNION ALL SELECT 'source', source, score FROM ds)
{describe_sql('dimension, member', 'flat', 'score')}""")
def breakdowns(t):
    return rounded(ev.breakdowns(doc_scores(t), "score", ["lang", "flag", "kind", "source"]))


@query("g9_multi_membership", f"""WITH flat AS (SELECT DISTINCT l_orderkey, l_suppkey AS member FROM lineitem), s AS (SELECT member, o_totalprice AS score FROM flat JOIN orders ON o_orderkey = l_orderkey)
{describe_sql('member', 's', 'score')}""")
def membership(t):
    # The suppliers of an order's lines, repeated ones included.
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_suppkey").alias("members"))
    scored = lists.join(t.orders, "o_orderkey").select("members", F.col("o_totalprice").alias("score"))
    return rounded(ev.multi_membership_stats(scored, "members", "score"))


@query("g10_percentile_linear", """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def linear(t):
    return rounded(ev.percentile_linear(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}), ("p50", "p95"))


def nearest_sql(key, source, value, pcts):
    picks = ", ".join(f"s[CAST(round_even({p / 100.0} * (len(s) - 1), 0) AS BIGINT) + 1] AS p{p}" for p in pcts)
    return f"SELECT {key}, CAST(len(s) AS BIGINT) AS n, {picks}, s[len(s)] AS max FROM (SELECT {key}, list_sort(list({value})) AS s FROM {source} GROUP BY {key})"


@query("g11_percentile_nearest", nearest_sql("source", "documents", "n_chars", (50, 90, 99)))
def nearest(t):
    return ev.percentile_nearest(t.documents, ["source"], "n_chars", {"p50": 50, "p90": 90, "p99": 99})


@query("g12_quartiles_exclusive", """WITH s AS (SELECT user_id, count(*) AS n, list_sort(list(value)) AS s FROM events GROUP BY user_id),
j AS (SELECT *, greatest(1, least(n - 1, CAST(floor((n + 1) * 0.25) AS BIGINT))) AS j1, greatest(1, least(n - 1, CAST(floor((n + 1) * 0.75) AS BIGINT))) AS j3 FROM s)
SELECT user_id, n, round(CASE WHEN n < 2 THEN s[1] ELSE s[j1] * (1 - ((n + 1) * 0.25 - j1)) + s[j1 + 1] * ((n + 1) * 0.25 - j1) END, 6) AS p25,
  round(CASE WHEN n < 2 THEN s[1] ELSE s[j3] * (1 - ((n + 1) * 0.75 - j3)) + s[j3 + 1] * ((n + 1) * 0.75 - j3) END, 6) AS p75 FROM j""")
def quartiles(t):
    return rounded(ev.quartiles_exclusive(t.events, ["user_id"], "value"), ("p25", "p75"))


@query("g13_latency_summary", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM r WHERE i > 3 GROUP BY event_type""")
def latency(t):
    return rounded(ev.latency_summary(t.events, "event_type", "value", ["ts", "event_id"]), ("mean", "std", "p50", "p95", "p99"))


@query("g13_end_to_end", """WITH w AS (SELECT user_id, sum(value) FILTER (event_type = 'view') AS a, sum(value) FILTER (event_type = 'click') AS b, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS rerank_ms FROM events GROUP BY user_id)
SELECT user_id, round(coalesce(a, 0) + coalesce(b, 0) + rerank_ms, 4) AS end_to_end FROM w WHERE rerank_ms > 0""")
def e2e(t):
    wide = t.events.groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.sum("value")).na.fill(0.0, ["purchase"])
    return ev.end_to_end(wide, ["view", "click", "purchase"], "purchase").select("user_id", F.round("end_to_end", 4).alias("end_to_end"))


# ------------------------------------------------------------- regressions

NAMES = ["r10", "mrr"]


def run(t, setup):
    return metrics(t).filter(F.col("setup") == setup).drop("setup")


DELTA = METRICS + """,
un AS (SELECT qid, setup, 'r10' AS metric, r10 AS value FROM metrics UNION ALL SELECT qid, setup, 'mrr', mrr FROM metrics),
delta AS (SELECT a.qid, a.metric, a.value AS current, b.value AS baseline, round(coalesce(a.value, 0) - coalesce(b.value, 0), 6) AS delta
  FROM un a JOIN un b ON a.qid = b.qid AND a.metric = b.metric WHERE a.setup = 'hybrid' AND b.setup = 'dense')"""


@query("g14_baseline_delta", f"WITH {DELTA} SELECT qid, metric, current, baseline, delta FROM delta")
def delta(t):
    m = metrics(t)
    return ev.baseline_delta(m.filter("setup = 'hybrid'"), m.filter("setup = 'dense'"), ["qid"], NAMES)


@query("g14_delta_verdict", f"""WITH {DELTA} SELECT count(*) AS n, round(avg(abs(delta)), 6) AS mean_abs_delta,
  CASE WHEN round(avg(abs(delta)), 6) < 0.03 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM delta""")
def delta_verdict(t):
    return ev.delta_verdict(delta(t))


def runs(t):
    """Two runs over the two setups: the second run swaps their scores."""
    m = metrics(t).filter(F.col("setup").isin("dense", "hybrid"))
    swapped = m.withColumn("setup", F.when(F.col("setup") == "dense", "hybrid").otherwise("dense"))
    return m, swapped


REG = METRICS + """,
old AS (SELECT * FROM metrics WHERE setup IN ('dense', 'hybrid')),
new AS (SELECT * REPLACE (CASE setup WHEN 'dense' THEN 'hybrid' ELSE 'dense' END AS setup) FROM old),
reg AS (SELECT qid, setup, n.r10 AS post, o.r10 AS pre, round(n.r10 - o.r10, 6) AS delta FROM new n JOIN old o USING (qid, setup) WHERE round(n.r10 - o.r10, 6) < 0),
frag AS (SELECT DISTINCT a.qid, a.setup FROM hits a JOIN gold g ON g.qid = a.qid AND g.chunk_id = a.chunk_id
  JOIN hits b ON b.qid = a.qid AND b.setup = a.setup AND b.rank > 10 AND b.rank <= 20 AND abs(a.score - b.score) < 1e-9 WHERE a.rank <= 10)"""


@query("g15_regressions", f"WITH {REG} SELECT qid, setup, post, pre, delta, abs(delta) > 0.25 AS severe FROM reg")
def regress(t):
    old, new = runs(t)
    return ev.regressions(new, old)


@query("g16_boundary_fragile", f"WITH {REG} SELECT qid, setup FROM frag")
def fragile(t):
    return ev.boundary_fragile(hits(t), gold(t))


@query("g17_verdict", f"""WITH {REG},
sev AS (SELECT count(*) AS n FROM reg WHERE abs(delta) > 0.25 AND NOT (setup = 'hybrid' AND EXISTS (SELECT 1 FROM frag WHERE frag.qid = reg.qid AND frag.setup = 'hybrid'))),
dr AS (SELECT count(*) AS n FROM (SELECT setup, round(avg(r10), 6) AS m FROM new GROUP BY setup) x JOIN (SELECT setup, round(avg(r10), 6) AS m FROM old GROUP BY setup) y USING (setup) WHERE x.m < y.m)
SELECT sev.n AS n_severe, dr.n AS n_setup_drops, CASE WHEN sev.n = 0 AND dr.n = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM sev, dr""")
def verdict(t):
    old, new = runs(t)
    return ev.run_verdict(ev.regressions(new, old), fragile(t), ev.setup_means(new), ev.setup_means(old))


@query("g17_go_verdict", f"WITH {METRICS} SELECT setup, median(r10) AS r10, median(mrr) AS mrr, CASE WHEN median(r10) >= 0.85 AND median(mrr) >= 0.2 THEN 'GO' ELSE 'NO-GO' END AS verdict FROM metrics GROUP BY setup")
def go(t):
    return ev.go_verdict(ev.medians(metrics(t), ["setup"], ["r10", "mrr"]), {"r10": 0.85, "mrr": 0.20})


@query("g18_zero_recall", f"WITH {METRICS} SELECT qid, setup FROM metrics WHERE n_gold > 0 AND r10 = 0")
def zero(t):
    return ev.zero_recall(gold(t), hits(t), SETUPS)


@query("g19_zero_recall_class", f"""WITH {METRICS},
z AS (SELECT DISTINCT qid FROM metrics WHERE n_gold > 0 AND r10 = 0 AND setup = 'hybrid'),
corpus AS (SELECT DISTINCT s_suppkey AS chunk_id FROM supplier WHERE s_acctbal > 0),
per AS (SELECT g.qid, count(*) FILTER (c.chunk_id IS NULL) AS n_absent, min(pl) AS best_rank, min(rr) AS rerank_rank FROM gold g JOIN z USING (qid)
  LEFT JOIN corpus c USING (chunk_id) LEFT JOIN (SELECT qid, chunk_id, min(rank) FILTER (setup IN ('dense', 'hybrid')) AS pl, min(rank) FILTER (setup = 'rerank') AS rr
    FROM hits GROUP BY ALL) h ON h.qid = g.qid AND h.chunk_id = g.chunk_id GROUP BY g.qid),
cl AS (SELECT *, CASE WHEN n_absent > 0 THEN 'a' WHEN best_rank IS NULL THEN 'b' WHEN best_rank > 10 THEN 'd' ELSE 'recheck' END AS class FROM per)
SELECT qid, n_absent, best_rank, rerank_rank, class, class = 'd' AND coalesce(rerank_rank <= 10, FALSE) AS rerank_lifts FROM cl""")
def zero_class(t):
    z = zero(t).filter("setup = 'hybrid'")
    corpus = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("chunk_id"))
    return ev.zero_recall_class(z, gold(t), corpus, hits(t), ["dense", "hybrid"], "rerank")


@query("g19_split_alternatives", """WITH lc AS (SELECT DISTINCT 'doc' || l_suppkey || '__art_' || l_partkey || CASE WHEN l_linenumber > 3 THEN '__paras_1_' || l_linenumber ELSE '' END AS chunk_id FROM lineitem),
g AS (SELECT DISTINCT 'doc' || l_suppkey || '__art_' || l_partkey AS chunk_id FROM lineitem)
SELECT g.chunk_id, lc.chunk_id AS alternative FROM g JOIN lc ON starts_with(lc.chunk_id, g.chunk_id || '__') WHERE g.chunk_id NOT IN (SELECT chunk_id FROM lc)""")
def split_alternatives(t):
    from pandekt.plans.retrieval import line_chunks
    g = t.lineitem.select(F.concat(F.lit("doc"), F.col("l_suppkey").cast("string"), F.lit("__art_"), F.col("l_partkey").cast("string")).alias("chunk_id"))
    return ev.split_alternatives(g, line_chunks(t))


@query("g20_tradeoff", f"""WITH {METRICS} SELECT a.qid, a.r10 AS before, b.r10 AS after, CASE WHEN b.r10 > 0 THEN 'gained' ELSE 'still_zero' END AS outcome
FROM metrics a JOIN metrics b USING (qid) WHERE a.setup = 'dense' AND b.setup = 'rerank' AND a.r10 = 0""")
def tradeoff(t):
    return ev.tradeoff(metrics(t), "dense", "rerank")


@query("g21_top1_separation", f"""WITH {METRICS} SELECT setup, CASE WHEN n_gold > 0 THEN 'positive' ELSE 'empty' END AS kind, count(*) AS n, round(avg(score), 4) AS mean, round(median(score), 4) AS median
FROM hits JOIN metrics USING (qid, setup) WHERE rank = 1 GROUP BY ALL""")
def separation(t):
    s = ev.top1_separation(hits(t), metrics(t))
    return s.withColumn("mean", F.round("mean", 4)).withColumn("median", F.round("median", 4))


@query("g22_median_block", f"""WITH {METRICS} SELECT setup, count(*) AS n, count(*) FILTER (r10 = 1) AS n_r10_1, count(*) FILTER (r10 = 0) AS n_r10_0,
  median(r5) AS r5_med, median(r10) AS r10_med, median(r20) AS r20_med, median(mrr) AS mrr_med FROM metrics GROUP BY setup""")
def block(t):
    return ev.median_block(metrics(t), ["setup"])


@query("g23_outlier_groups", f"""WITH {METRICS}, pos AS (SELECT * FROM metrics JOIN parts USING (qid) WHERE n_gold > 0 AND setup = 'hybrid'),
lim AS (SELECT greatest(0.0, median(r10) - 0.20) AS l FROM pos)
SELECT p_type, median(r10) AS median, round(any_value(l), 6) AS limit, median(r10) < any_value(l) AS outlier FROM pos, lim GROUP BY p_type""")
def outliers(t):
    o = ev.outlier_groups(metrics(t).filter("setup = 'hybrid'"), parts(t), "p_type")
    return o.withColumn("limit", F.round("limit", 6))


@query("g24_bottom_n", f"""WITH {METRICS}, un AS (SELECT qid, setup, 'r10' AS metric, r10 AS value FROM metrics UNION ALL SELECT qid, setup, 'ndcg', ndcg FROM metrics)
SELECT qid, setup, metric, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, qid, setup) AS rank FROM un WHERE value IS NOT NULL) WHERE rank <= 5""")
def bottom(t):
    return ev.bottom_n(metrics(t), ["qid", "setup"], ["r10", "ndcg"])


@query("g25_paired_compare", """WITH a AS (SELECT conv_id, min_by(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT DISTINCT conv_id AS left_qid, conv_id + 1 AS right_qid FROM conversations)
SELECT left_qid, right_qid, CASE WHEN x.answer IS NULL OR y.answer IS NULL THEN 'n/a' WHEN substr(x.answer, 1, 200) <> substr(y.answer, 1, 200) THEN 'yes' ELSE 'no' END AS differs
FROM p LEFT JOIN a x ON x.conv_id = left_qid LEFT JOIN a y ON y.conv_id = right_qid""")
def paired(t):
    c = t.conversations
    answers = c.filter("role = 'assistant'").groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("answer"))
    pairs = c.select(F.col("conv_id").alias("left_qid"), (F.col("conv_id") + 1).alias("right_qid")).distinct()
    return ev.paired_compare(pairs, answers)


@query("g26_drift_check", f"""WITH {METRICS},
cur AS (SELECT use_case, median(r10) AS r10, median(mrr) AS mrr FROM metrics JOIN parts USING (qid) WHERE setup = 'hybrid' GROUP BY use_case),
arc AS (SELECT use_case, median(r10) AS r10, median(mrr) AS mrr FROM metrics JOIN parts USING (qid) WHERE setup = 'dense' GROUP BY use_case),
u AS (SELECT use_case, 'r10' AS metric, c.r10 AS current, a.r10 AS baseline FROM cur c JOIN arc a USING (use_case) UNION ALL SELECT use_case, 'mrr', c.mrr, a.mrr FROM cur c JOIN arc a USING (use_case))
SELECT use_case, metric, current, baseline, round(coalesce(current, 0) - coalesce(baseline, 0), 6) AS delta, abs(round(coalesce(current, 0) - coalesce(baseline, 0), 6)) > 0.05 AS drift FROM u""")
def drift(t):
    m = metrics(t).join(parts(t).select("qid", "use_case"), "qid")
    cur = ev.medians(m.filter("setup = 'hybrid'"), ["use_case"], ["r10", "mrr"])
    arc = ev.medians(m.filter("setup = 'dense'"), ["use_case"], ["r10", "mrr"])
    return ev.drift_check(cur, arc, "use_case", ["r10", "mrr"])


@query("g27_score_zones", f"""WITH {METRICS}, z AS (SELECT setup, count(*) AS n, count(*) FILTER (ndcg < 0.4) AS low, count(*) FILTER (ndcg >= 0.4 AND ndcg < 0.65) AS mid,
  count(*) FILTER (ndcg >= 0.65 AND ndcg <= 0.85) AS good, count(*) FILTER (ndcg > 0.85) AS high FROM metrics WHERE ndcg IS NOT NULL GROUP BY setup)
SELECT *, round(low / n, 6) AS low_share, round(mid / n, 6) AS mid_share, round(good / n, 6) AS good_share, round(high / n, 6) AS high_share FROM z""")
def zones(t):
    return ev.score_zones(metrics(t), "setup", "ndcg")


LIMITS = [r"nicht\s+(die|der|das)", r"pas\s+(de|la|le).{0,40}que", r"not\s+the"]


@query("g28_limit_declaration", r"""WITH a AS (SELECT turn, text, regexp_matches(text, '(?is)(?:nicht\s+(die|der|das))|(?:pas\s+(de|la|le).{0,40}que)|(?:not\s+the)') AS detected FROM conversations WHERE role = 'assistant')
SELECT turn > 1 AS flag, detected, count(*) AS n, count(*) FILTER (NOT detected AND length(trim(text)) > 200) AS n_substantive FROM a GROUP BY ALL""")
def limits(t):
    a = t.conversations.filter("role = 'assistant'").withColumn("flag", F.col("turn") > 1)
    return ev.limit_table(a, "flag", "text", LIMITS)


LIMIT_PHRASES = ["La norma non è inclusa nel corpus normativo di riferimento.", "non sono presenti, purtroppo, nel nostro Corpus", "Il contesto normativo fornito non contiene la regola.",
                 "dati ASSENTI nel contesto", "Sarebbe necessario fare riferimento alla legge.", "Il contesto contiene tutto.", "non presente nel\ncontesto"]


@query("g28_default_phrases", f"""WITH a AS (SELECT quality, [{", ".join("'" + p.replace("'", "''") + "'" for p in LIMIT_PHRASES)}][doc_id % {len(LIMIT_PHRASES)} + 1] || ' ' || doc_id AS answer FROM labels),
d AS (SELECT *, regexp_matches(answer, '{"|".join(ev.LIMIT_PATTERNS)}', 'is') AS detected FROM a)
SELECT quality, detected, count(*) AS n, count(*) FILTER (NOT detected AND length(trim(answer)) > 200) AS n_substantive FROM d GROUP BY ALL""")
def default_limits(t):
    phrase = F.element_at(F.array(*[F.lit(p) for p in LIMIT_PHRASES]), (F.pmod(F.col("doc_id"), F.lit(len(LIMIT_PHRASES))) + 1).cast("int"))
    return ev.limit_table(t.labels.select("quality", F.concat_ws(" ", phrase, F.col("doc_id").cast("string")).alias("answer")), "quality")


RESCUE = HITS + """,
ff AS (SELECT qid, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM hits GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM ff) WHERE rank <= 20),
rr AS (SELECT g.qid, any_value(p.use_case) AS use_case, count(*) AS n_gold, count(f.chunk_id) AS n_found, round(count(f.chunk_id) / count(*), 6) AS ratio FROM gold g
  LEFT JOIN fused f ON f.qid = g.qid AND f.chunk_id = g.chunk_id LEFT JOIN parts p ON p.qid = g.qid GROUP BY g.qid)"""


@query("g29_rescue_ratio", f"WITH {RESCUE} SELECT * FROM rr")
def ratio(t):
    from pandekt.operators.fusion import fuse
    return ev.rescue_ratio(fuse(hits(t), 20), gold(t), parts(t).select("qid", "use_case"))


@query("g29_rescue_medians", f"WITH {RESCUE} SELECT use_case, median(ratio) AS ratio FROM rr GROUP BY use_case")
def ratio_medians(t):
    return ev.medians(ratio(t), ["use_case"], ["ratio"])


def calls(t):
    v = F.col("value")
    return t.events.select("event_id", "ts", ev.usage_cost(v * 100, v * 10, v * 50, v * 20).alias("cost"))


CALLS = "calls AS (SELECT event_id, ts, value * 100 / 1000000 * 3 + value * 10 / 1000000 * 3.75 + value * 50 / 1000000 * 0.3 + value * 20 / 1000000 * 15 AS cost FROM events)"


@query("g30_usage_cost", f"""WITH {CALLS}, r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq, sum(cost) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS rc FROM calls)
SELECT event_id, seq, round(rc, 9) AS running_cost, seq >= 80 AND rc > 1.0 AS stop FROM r""")
def cost(t):
    w = ev.budget_watch(calls(t), ["ts", "event_id"], "cost", 1.0)
    return w.select("event_id", "seq", F.round("running_cost", 9).alias("running_cost"), "stop")


@query("g30_first_breach", f"""WITH {CALLS}, r AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, sum(cost) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS rc FROM calls)
SELECT min(seq) AS stop_at, count(*) AS n_over FROM r WHERE seq >= 80 AND rc > 1.0""")
def breach(t):
    return ev.first_breach(cost(t))


@query("g31_resume", """SELECT doc_id, quality, 'done' AS state FROM labels
UNION ALL SELECT doc_id, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume(t):
    done = t.labels.select("doc_id", "quality", F.lit("done").alias("state"))
    return ev.resume(t.documents, done, "doc_id", lambda rest: rest.select(
        "doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).cast(done.schema["quality"].dataType).alias("quality"), F.lit("new").alias("state")))


@query("g32_subset_filter", "SELECT d.doc_id, lang, n_chars, row_number() OVER (ORDER BY l.quality, l.doc_id) AS pos FROM labels l JOIN documents d USING (doc_id)")
def subset(t):
    from pandekt.operators.ordered import row_positions
    wanted = row_positions(t.labels.select("doc_id", "quality"), [], ["quality", "doc_id"])
    return ev.subset_filter(t.documents, wanted, "doc_id").select("doc_id", "lang", "n_chars", "pos")
