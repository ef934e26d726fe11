"""Retrieval metrics, run comparison and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pandekt.functions.vectors import cosine
from pandekt.operators import quantiles as qt
from pandekt.operators.ordered import MAX_GROUP, row_positions, running_sum, top_k
from pandekt.session import cut_lineage

# --------------------------------------------------------------- pair checks


def pair_similarity_class(pairs: DataFrame, high: float, medium: float, digits: int = 6) -> DataFrame:
    """Cosine of each (a, b) pair, its class by two thresholds, agreement with ``expected``."""
    s = pairs.withColumn("similarity", F.round(cosine(F.col("a"), F.col("b")), digits))
    cls = F.when(F.col("similarity") >= high, "alto").when(F.col("similarity") >= medium, "medio").otherwise("basso")
    return s.withColumn("class", cls).withColumn("agrees", F.col("class") == F.col("expected"))


def pair_verdict(classed: DataFrame, pass_at: int = 12, partial_at: int = 9) -> DataFrame:
    """PASS / PARTIAL / FAIL per encoder variant by number of agreeing pairs."""
    g = classed.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if("agrees").alias("n_agree"))
    return g.withColumn("verdict", F.when(F.col("n_agree") >= pass_at, "PASS").when(F.col("n_agree") >= partial_at, "PARTIAL").otherwise("FAIL"))


def expectation_check(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Is the expected id (exact) or the expected document among the hits?"""
    j = expected.join(hits.select("qid", "chunk_id"), "qid", "left")
    return j.groupBy("qid").agg(
        F.coalesce(F.bool_or(F.col("chunk_id") == F.col("want_id")), F.lit(False)).alias("found_id"),
        F.coalesce(F.bool_or(F.substring_index("chunk_id", "__", 1) == F.col("want_doc")), F.lit(False)).alias("found_doc"),
    )


# ------------------------------------------------------------------- metrics


def _gold_ranks(gold: DataFrame, hits: DataFrame, setups: list[str]) -> DataFrame:
    """One row per (qid, setup, gold chunk) with its best rank or null."""
    g = gold.select("qid", "chunk_id").distinct().withColumn("setup", F.explode(F.array(*[F.lit(s) for s in setups])))
    h = hits.groupBy("qid", "setup", "chunk_id").agg(F.min("rank").alias("rank"))
    return g.join(h, ["qid", "setup", "chunk_id"], "left")


def recall_at_k(k: int) -> Column:
    """Aggregate over gold rows: share of gold found in the top k."""
    return F.count_if(F.col("rank") <= k) / F.count(F.lit(1))


def mrr_at_k(k: int) -> Column:
    """Aggregate: 1 / rank of the first gold within k, else 0."""
    return F.coalesce(F.lit(1.0) / F.min(F.when(F.col("rank") <= k, F.col("rank"))), F.lit(0.0))


def ndcg_at_k(k: int) -> Column:
    """Aggregate: binary gain with log2 discount over the ideal of min(k, gold)."""
    dcg = F.sum(F.when(F.col("rank") <= k, F.lit(1.0) / F.log2(F.col("rank") + 1.0)).otherwise(F.lit(0.0)))
    ideal = [0.0]
    import math
    for i in range(1, k + 1):
        ideal.append(ideal[-1] + 1.0 / math.log2(i + 1))
    table = F.array(*[F.lit(x) for x in ideal])
    return dcg / F.element_at(table, (F.least(F.lit(k), F.count(F.lit(1))) + 1).cast("int"))


def query_metrics(queries: DataFrame, gold: DataFrame, hits: DataFrame, setups: list[str], recalls: tuple[int, ...] = (5, 10, 20),
                  mrr_window: int = 10, ndcg_k: int = 10, empty: float | None = None, digits: int = 9) -> DataFrame:
    """Per (qid, setup): recall, MRR, nDCG and first gold rank.

    Questions without gold keep a row with ``empty`` (null by default) metrics.
    Everything is one aggregation over gold rows, so a question with very many
    gold chunks is combined before the shuffle.
    """
    per = _gold_ranks(gold, hits, setups).groupBy("qid", "setup").agg(
        F.count(F.lit(1)).alias("n_gold"),
        *[F.round(recall_at_k(k), digits).alias(f"r{k}") for k in recalls],
        F.round(mrr_at_k(mrr_window), digits).alias("mrr"),
        F.round(ndcg_at_k(ndcg_k), digits).alias("ndcg"),
        F.min("rank").alias("first_gold_rank"),
    )
    grid = queries.select("qid").withColumn("setup", F.explode(F.array(*[F.lit(s) for s in setups])))
    metrics = [f"r{k}" for k in recalls] + ["mrr", "ndcg"]
    out = grid.join(per, ["qid", "setup"], "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0).cast("long")))
    if empty is not None:
        out = out.select(*[F.coalesce(F.col(c), F.lit(float(empty))).alias(c) if c in metrics else c for c in out.columns])
    return out


def metric_names(metrics: DataFrame) -> list[str]:
    return [c for c in metrics.columns if c in ("mrr", "ndcg") or (c[0] == "r" and c[1:].isdigit())]


def setup_means(metrics: DataFrame, digits: int = 6) -> DataFrame:
    """Mean of the non-null metrics per setup with positive and empty counts."""
    return metrics.groupBy("setup").agg(
        F.count_if(F.col("n_gold") > 0).alias("n_positive"), F.count_if(F.col("n_gold") == 0).alias("n_empty"),
        *[F.round(F.avg(m), digits).alias(m) for m in metric_names(metrics)],
    )


def grouped_means(metrics: DataFrame, membership: DataFrame, group: str, setups: list[str], digits: int = 6) -> DataFrame:
    """Means per (group, setup) over positive questions; empty groups give n = 0.

    ``membership`` maps qid to group and may list a question several times
    under different groups (named clusters) or just once (use case).
    """
    names = metric_names(metrics)
    positive = metrics.filter(F.col("n_gold") > 0)
    per = positive.join(membership.select("qid", group).distinct(), "qid").groupBy(group, "setup").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), digits).alias(m) for m in names])
    grid = membership.select(group).distinct().withColumn("setup", F.explode(F.array(*[F.lit(s) for s in setups])))
    return grid.join(per, [group, "setup"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


# ---------------------------------------------------------- score statistics


def breakdowns(scores: DataFrame, value: str, dims: list[str], max_rows: int = qt.MAX_ROWS) -> DataFrame:
    """``describe`` for the whole table and for every value of each dimension.

    Rows are fanned out once per dimension (a fixed number) and then go
    through one aggregation; the overall block is dimension ``all``.
    """
    pairs = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("member")),
                    *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in dims])
    flat = scores.select(F.explode(pairs).alias("_p"), F.col(value)).select("_p.dimension", "_p.member", value)
    return qt.describe(flat, ["dimension", "member"], value, max_rows)


def multi_membership_stats(scores: DataFrame, members: str, value: str, max_rows: int = qt.MAX_ROWS) -> DataFrame:
    """``describe`` per member of an array column; a row counts once in each distinct member."""
    flat = scores.select(F.explode(F.array_distinct(members)).alias("member"), F.col(value))
    return qt.describe(flat, ["member"], value, max_rows)


def percentile_linear(df: DataFrame, group: list[str], value: str, ps: dict[str, float], max_rows: int = qt.MAX_ROWS) -> DataFrame:
    """Percentiles interpolated at (n-1)p."""
    ranks: dict = {}
    for label, p in ps.items():
        ranks.update(qt.linear_ranks(label, p))
    s = qt.order_stats(df, group, value, ranks, max_rows)
    return s.select(*group, "n", *[qt.linear_value(label, p).alias(label) for label, p in ps.items()])


def percentile_nearest(df: DataFrame, group: list[str], value: str, pcts: dict[str, float], max_rows: int = qt.MAX_ROWS) -> DataFrame:
    """Nearest-rank percentiles, halves rounded to even, plus the maximum."""
    return qt.order_stats(df, group, value, {
        **{label: qt.nearest_rank(p) for label, p in pcts.items()}, "max": lambda n: n,
    }, max_rows)


def quartiles_exclusive(df: DataFrame, group: list[str], value: str, max_rows: int = qt.MAX_ROWS) -> DataFrame:
    """p25 and p75 at positions p(n+1)."""
    s = qt.order_stats(df, group, value, {**qt.exclusive_ranks("p25", 0.25), **qt.exclusive_ranks("p75", 0.75)}, max_rows)
    return s.select(*group, "n", qt.exclusive_value("p25", 0.25).alias("p25"), qt.exclusive_value("p75", 0.75).alias("p75"))


def drop_warmup(log: DataFrame, step: str, order: list[str], warmup: int = 3) -> DataFrame:
    """Remove the first ``warmup`` rows of every step.

    Only those few rows are ranked (a top-k per step); the rest is kept by an
    anti join, so no step is ordered as a whole.
    """
    first = top_k(log.select(step, *order), [step], [F.asc(c) for c in order], warmup, "_i").drop("_i")
    return log.join(first, [step, *order], "left_anti")


def latency_summary(log: DataFrame, step: str, value: str, order: list[str], warmup: int = 3, max_rows: int = qt.MAX_ROWS) -> DataFrame:
    """n, mean, sample std, p50, p95 and p99 per step after dropping the warm-up."""
    kept = drop_warmup(log, step, order, warmup)
    basic = kept.groupBy(step).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return percentile_linear(kept, [step], value, {"p50": 0.50, "p95": 0.95, "p99": 0.99}, max_rows).join(basic, step)


def end_to_end(wide: DataFrame, steps: list[str], rerank: str) -> DataFrame:
    """Sum of the steps of every question whose rerank time is positive."""
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in steps), F.lit(0.0))
    return wide.filter(F.col(rerank) > 0).withColumn("end_to_end", total)


# -------------------------------------------------------------- regressions


def unpivot(metrics: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    return metrics.unpivot(keys, names, "metric", "value")


def baseline_delta(current: DataFrame, baseline: DataFrame, keys: list[str], names: list[str], digits: int = 6) -> DataFrame:
    """Per key and metric: current minus stored value (null counts 0)."""
    a = unpivot(current, names, keys).withColumnRenamed("value", "current")
    b = unpivot(baseline, names, keys).withColumnRenamed("value", "baseline")
    j = a.join(b, [*keys, "metric"])
    return j.withColumn("delta", F.round(F.coalesce("current", F.lit(0.0)) - F.coalesce("baseline", F.lit(0.0)), digits))


def delta_verdict(deltas: DataFrame, limit: float = 0.03, digits: int = 6) -> DataFrame:
    """Mean absolute delta over everything and PASS when below ``limit``."""
    m = deltas.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("delta")), digits).alias("mean_abs_delta"))
    return m.withColumn("verdict", F.when(F.col("mean_abs_delta") < limit, "PASS").otherwise("FAIL"))


def regressions(new: DataFrame, old: DataFrame, metric: str = "r10", severe: float = 0.25, digits: int = 6) -> DataFrame:
    """(qid, setup) rows whose metric dropped, with the severe flag."""
    a = new.select("qid", "setup", F.col(metric).alias("post"))
    b = old.select("qid", "setup", F.col(metric).alias("pre"))
    d = a.join(b, ["qid", "setup"]).withColumn("delta", F.round(F.col("post") - F.col("pre"), digits))
    return d.filter(F.col("delta") < 0).withColumn("severe", F.abs("delta") > severe)


def boundary_fragile(hits: DataFrame, gold: DataFrame, k: int = 10, depth: int = 20, eps: float = 1e-9) -> DataFrame:
    """Questions where a gold inside the top k ties with a chunk ranked k+1..depth.

    The band join is an equi-join on (qid, score cell) over neighbouring
    cells of width ``eps``. Each question has at most ``depth`` hits here.
    """
    cell = F.floor(F.col("score") / F.lit(eps))
    inside = hits.filter(F.col("rank") <= k).join(gold.select("qid", "chunk_id").distinct(), ["qid", "chunk_id"], "left_semi")
    a = inside.select("qid", "setup", F.col("score").alias("_g"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    b = hits.filter((F.col("rank") > k) & (F.col("rank") <= depth)).select("qid", "setup", F.col("score").alias("_o"), cell.alias("_cell"))
    return a.join(b, ["qid", "setup", "_cell"]).filter(F.abs(F.col("_g") - F.col("_o")) < eps).select("qid", "setup").distinct()


def run_verdict(regressed: DataFrame, fragile: DataFrame, new_means: DataFrame, old_means: DataFrame,
                fragile_setup: str = "hybrid", metric: str = "r10") -> DataFrame:
    """PASS iff no severe regression survives the fragile rule and no setup mean drops."""
    excused = fragile.filter(F.col("setup") == fragile_setup).select("qid", "setup")
    severe = regressed.filter("severe").join(excused, ["qid", "setup"], "left_anti").agg(F.count(F.lit(1)).alias("n_severe"))
    drops = new_means.select("setup", F.col(metric).alias("_n")).join(old_means.select("setup", F.col(metric).alias("_o")), "setup").agg(
        F.count_if(F.col("_n") < F.col("_o")).alias("n_setup_drops"))
    return severe.select("n_severe", drops.scalar().alias("n_setup_drops")).withColumn(
        "verdict", F.when((F.col("n_severe") == 0) & (F.col("n_setup_drops") == 0), "PASS").otherwise("FAIL"))


def go_verdict(medians: DataFrame, limits: dict[str, float]) -> DataFrame:
    """GO iff every named median reaches its limit."""
    ok = F.lit(True)
    for name, limit in limits.items():
        ok = ok & (F.coalesce(F.col(name), F.lit(-1.0)) >= limit)
    return medians.withColumn("verdict", F.when(ok, "GO").otherwise("NO-GO"))


def zero_recall(gold: DataFrame, hits: DataFrame, setups: list[str], k: int = 10) -> DataFrame:
    """(qid, setup) of questions with gold of which none is in the top k."""
    r = _gold_ranks(gold, hits, setups).groupBy("qid", "setup").agg(F.min("rank").alias("_b"))
    return r.filter(F.col("_b").isNull() | (F.col("_b") > k)).select("qid", "setup")


def zero_recall_class(zero: DataFrame, gold: DataFrame, chunks: DataFrame, hits: DataFrame, plain: list[str], reranked: str,
                      depth: int = 50, k: int = 10) -> DataFrame:
    """Why a question found nothing: a = gold absent from the corpus, b = never
    retrieved, d = near miss (with the flag whether reranking lifts it), else recheck."""
    g = gold.select("qid", "chunk_id").distinct().join(zero.select("qid").distinct(), "qid", "left_semi")
    known = chunks.select("chunk_id").distinct().withColumn("_known", F.lit(1))
    best = hits.filter(F.col("rank") <= depth).groupBy("qid", "chunk_id").agg(
        F.min(F.when(F.col("setup").isin(plain), F.col("rank"))).alias("_plain"),
        F.min(F.when(F.col("setup") == reranked, F.col("rank"))).alias("_rr"))
    per = g.join(known, "chunk_id", "left").join(best, ["qid", "chunk_id"], "left").groupBy("qid").agg(
        F.count_if(F.col("_known").isNull()).alias("n_absent"), F.min("_plain").alias("best_rank"), F.min("_rr").alias("rerank_rank"))
    cls = (F.when(F.col("n_absent") > 0, "a").when(F.col("best_rank").isNull(), "b").when(F.col("best_rank") > k, "d").otherwise("recheck"))
    return per.withColumn("class", cls).withColumn(
        "rerank_lifts", (F.col("class") == "d") & F.coalesce(F.col("rerank_rank") <= k, F.lit(False)))


def split_alternatives(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Split children that exist for gold ids absent from the corpus."""
    from pandekt.functions.ids import base_id
    absent = gold.select("chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    kids = chunks.select(F.col("chunk_id").alias("alternative"), base_id(F.col("chunk_id")).alias("chunk_id")).filter(
        F.col("alternative") != F.col("chunk_id"))
    return absent.join(kids, "chunk_id")


def tradeoff(metrics: DataFrame, before: str, after: str, metric: str = "r10") -> DataFrame:
    """Questions going 0 to positive between two setups, and those still 0."""
    a = metrics.filter(F.col("setup") == before).select("qid", F.col(metric).alias("before"))
    b = metrics.filter(F.col("setup") == after).select("qid", F.col(metric).alias("after"))
    return a.filter(F.col("before") == 0).join(b, "qid").withColumn(
        "outcome", F.when(F.col("after") > 0, "gained").otherwise("still_zero"))


def top1_separation(hits: DataFrame, metrics: DataFrame, max_rows: int = qt.MAX_ROWS) -> DataFrame:
    """Top-1 scores of questions with and without gold, per setup: n, mean, median."""
    kind = metrics.select("qid", "setup", F.when(F.col("n_gold") > 0, "positive").otherwise("empty").alias("kind"))
    top = hits.filter(F.col("rank") == 1).join(kind, ["qid", "setup"])
    return qt.describe(top, ["setup", "kind"], "score", max_rows).select("setup", "kind", "n", "mean", "median")


def medians(df: DataFrame, group: list[str], values: list[str], max_rows: int = qt.MAX_ROWS) -> DataFrame:
    """Exact medians of several columns per group, selected together. The values are read several times, so they are written once."""
    long = unpivot(cut_lineage(df.select(*group, *[F.col(v).cast("double").alias(v) for v in values])), values, group)
    s = qt.order_stats(long, [*group, "metric"], "value", {"_a": qt.lower_median, "_b": qt.upper_median}, max_rows)
    s = s.withColumn("median", qt.median_from(F.col("_a"), F.col("_b")))
    keys = group or ["_all"]
    s = s if group else s.withColumn("_all", F.lit(0))
    out = s.groupBy(*keys).pivot("metric", values).agg(F.max("median"))
    return out if group else out.drop("_all")


def median_block(metrics: DataFrame, group: list[str], max_rows: int = qt.MAX_ROWS) -> DataFrame:
    """Medians of the metrics and the counts of recall@10 equal to 1 and to 0."""
    names = [n for n in metric_names(metrics) if n != "ndcg"]
    m = medians(metrics, group, names, max_rows)
    for n in names:
        m = m.withColumnRenamed(n, f"{n}_med")
    c = metrics.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r10") == 1).alias("n_r10_1"), F.count_if(F.col("r10") == 0).alias("n_r10_0"))
    return c.join(m, group, "left")


def outlier_groups(metrics: DataFrame, membership: DataFrame, group: str, drop: float = 0.20, metric: str = "r10",
                   max_rows: int = qt.MAX_ROWS) -> DataFrame:
    """Groups whose median lies more than ``drop`` under the median of all positive questions."""
    positive = metrics.filter((F.col("n_gold") > 0) & F.col(metric).isNotNull())
    overall = medians(positive, [], [metric], max_rows)
    limit = F.greatest(F.lit(0.0), overall.scalar() - F.lit(drop))
    per = medians(positive.join(membership.select("qid", group), "qid"), [group], [metric], max_rows)
    return per.select(group, F.col(metric).alias("median"), limit.alias("limit")).withColumn("outlier", F.col("median") < F.col("limit"))


def bottom_n(scores: DataFrame, keys: list[str], names: list[str], n: int = 5) -> DataFrame:
    """The n lowest rows per metric, nulls left out."""
    long = unpivot(scores, names, keys).filter(F.col("value").isNotNull())
    return top_k(long, ["metric"], [F.asc("value"), *[F.asc(k) for k in keys]], n)


def paired_compare(pairs: DataFrame, answers: DataFrame, head: int = 200) -> DataFrame:
    """pairs(pair, left_qid, right_qid): do the answers differ in their first characters?"""
    a = answers.select(F.col("qid").alias("left_qid"), F.substring("answer", 1, head).alias("_l"))
    b = answers.select(F.col("qid").alias("right_qid"), F.substring("answer", 1, head).alias("_r"))
    j = pairs.join(a, "left_qid", "left").join(b, "right_qid", "left")
    return j.withColumn("differs", F.when(F.col("_l").isNull() | F.col("_r").isNull(), "n/a").when(F.col("_l") != F.col("_r"), "yes").otherwise("no")).drop("_l", "_r")


def drift_check(current: DataFrame, archived: DataFrame, key: str, names: list[str], limit: float = 0.05, digits: int = 6) -> DataFrame:
    """Current against archived medians, flagged when further apart than ``limit``."""
    d = baseline_delta(current, archived, [key], names, digits)
    return d.withColumn("drift", F.abs("delta") > limit)


ZONES = (0.40, 0.65, 0.85)


def score_zone(v: Column) -> Column:
    a, b, c = ZONES
    return F.when(v < a, "low").when(v < b, "mid").when(v <= c, "good").when(v.isNotNull(), "high")


def score_zones(scores: DataFrame, group: str, value: str, digits: int = 6) -> DataFrame:
    """Counts and shares of the score zones per group."""
    zones = ["low", "mid", "good", "high"]
    p = scores.filter(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(score_zone(F.col(value)) == z).alias(z) for z in zones])
    return p.select(group, "n", *zones, *[F.round(F.col(z) / F.col("n"), digits).alias(f"{z}_share") for z in zones])


# Phrases by which an answer declares that the corpus does not cover it.
LIMIT_PATTERNS = [
    r"non\s+(?:è\s+|sono\s+|sia\s+|siano\s+)?(?:inclus[oaie]|present[eai]).{0,40}corpus(?:\s+normativo)?(?:\s+di\s+riferimento)?",
    r"contesto\s+(?:normativo\s+)?(?:fornito\s+)?non\s+(?:contiene|include|riguarda)",
    r"(?:assent[ei]|non\s+present[ei])\s+nel\s+contesto",
    r"sarebbe\s+necessario\s+(?:disporre|fare\s+riferimento|consultare)",
]


def declares_limit(answer: Column, patterns: list[str] | None = None) -> Column:
    """Does the answer match one of the phrase families (no case, dot spans lines)?"""
    rx = "|".join(f"(?:{p})" for p in (LIMIT_PATTERNS if patterns is None else patterns))
    return answer.rlike(f"(?isuU)(?:{rx})")


def limit_table(answers: DataFrame, flag: str, answer: str = "answer", patterns: list[str] | None = None) -> DataFrame:
    """2 x 2 counts of the stored flag against the detected phrase, with long undeclared answers."""
    d = answers.withColumn("detected", declares_limit(F.col(answer), patterns))
    return d.groupBy(flag, "detected").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("detected") & (F.length(F.trim(answer)) > 200)).alias("n_substantive"))


def rescue_ratio(fused: DataFrame, gold: DataFrame, groups: DataFrame, k: int = 20, digits: int = 6) -> DataFrame:
    """Share of gold among the first k fused hits per question, with its group."""
    top = fused.filter(F.col("rank") <= k).select("qid", "chunk_id").distinct().withColumn("_hit", F.lit(1))
    per = gold.select("qid", "chunk_id").distinct().join(top, ["qid", "chunk_id"], "left").groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_gold"), F.count("_hit").alias("n_found"))
    return per.join(groups, "qid", "left").withColumn("ratio", F.round(F.col("n_found") / F.col("n_gold"), digits))


PRICE_IN, PRICE_OUT = 3.0, 15.0


def usage_cost(tokens_in: Column, cache_write: Column, cache_read: Column, tokens_out: Column,
               price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> Column:
    """Cost of a call; cache writes cost 1.25 and cache reads 0.1 of the input price."""
    million = 1_000_000.0
    return (tokens_in / million * price_in + cache_write / million * (price_in * 1.25)
            + cache_read / million * (price_in * 0.1) + tokens_out / million * price_out)


def budget_watch(calls: DataFrame, order: list[str], cost: str, limit: float, min_rows: int = 80, max_group: int = MAX_GROUP) -> DataFrame:
    """Running total over all calls and the stop flag (enough rows and over the limit)."""
    numbered = row_positions(calls, [], order, "seq", max_group)
    total = running_sum(numbered, [], ["seq"], cost, "running_cost", max_group)
    return total.withColumn("stop", (F.col("seq") >= min_rows) & (F.col("running_cost") > limit))


def first_breach(watched: DataFrame) -> DataFrame:
    """The first row carrying the stop flag."""
    return watched.agg(F.min(F.when(F.col("stop"), F.col("seq"))).alias("stop_at"), F.count_if("stop").alias("n_over"))


def resume(todo: DataFrame, done: DataFrame, key: str, process) -> DataFrame:
    """Finished rows plus the processed rest."""
    rest = todo.join(done.select(key), key, "left_anti")
    return done.unionByName(process(rest))


def subset_filter(df: DataFrame, wanted: DataFrame, key: str = "qid", strict: bool = True) -> DataFrame:
    """Only the listed ids, with their listed position; unknown ids are an error."""
    if strict:
        bad = [r[0] for r in wanted.join(df.select(key), key, "left_anti").select(key).limit(20).collect()]
        if bad:
            raise KeyError(f"unknown ids: {bad}")
    return df.join(wanted.select(key, "pos"), key)
