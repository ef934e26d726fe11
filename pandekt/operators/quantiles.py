"""Exact order statistics and the percentile conventions in use.

Values are selected, not ordered. A group is first known by its count and value
range. A range with more rows than can be settled at once is cut into 4,096 cells
of equal width, counted where the rows are read; only the cells that hold a wanted
rank are read again, as ranges of their own. Small ranges are settled from their
(value, count) pairs, at most ``max_rows`` of them in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pandekt.operators.ordered import running_sum
from pandekt.session import cut_lineage

RankRule = Callable[[Column], Column]
CELLS = 4096
MAX_ROWS = 65_536
#: Each round divides a range by 4,096. What values crowded at one end leave after the last one is ordered.
ROUNDS = 4


def _all_same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)])


def _cell(value: Column, lo: Column, hi: Column) -> Column:
    """Cell of a number between two finite bounds, never falling as the number grows; infinities and NaN have their own."""
    x = value.cast("double")
    # Halves, since the width of the whole range may overflow.
    inside = F.when(hi / 2 > lo / 2, F.least(F.lit(CELLS - 1), F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * CELLS))).otherwise(F.lit(0))
    return F.when(F.isnan(x), F.lit(CELLS + 1)).when(x == float("inf"), F.lit(CELLS)).when(x == float("-inf"), F.lit(-1)).otherwise(inside).cast("int")


def _holding(parts: Column, rank: Column) -> Column:
    """The part (a struct with a count ``c``) of a sorted array that holds a rank, with ``before``, the count up to it; null outside."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("int").alias("k"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        hit = (acc["at"] < rank) & (rank <= acc["at"] + x["c"])
        return F.struct((acc["at"] + x["c"]).alias("at"), F.when(hit, acc["at"]).otherwise(acc["before"]).alias("before"),
                        F.when(hit, acc["i"]).otherwise(acc["k"]).alias("k"), (acc["i"] + 1).alias("i"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["k"].isNotNull(), F.struct(F.get(parts, acc["k"]).alias("part"), acc["before"].alias("before"))))


def order_stats(df: DataFrame, group: list[str], value: str, ranks: dict[str, RankRule], max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per group: ``n`` and, per label, the value at the given 1-based rank.

    A rank rule maps the column ``n`` to a rank; a rank outside 1..n gives null.
    Values are numbers; null values are ignored, NaN is the greatest. Null keys
    are keys. Without ``group`` the table is one group, and an empty table gives
    no row. Ranges are joined to the rows on the group and its bounds: they are
    as many as groups, or labels of large groups.
    """
    ks = [f"_k{i}" for i in range(len(group))] or ["_k0"]
    keyed = [F.col(c).alias(k) for c, k in zip(group, ks, strict=True)] if group else [F.lit(0).alias("_k0")]
    rows = df.select(*keyed, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    x = F.col("_v").cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    groups = cut_lineage(rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b"), F.min(finite).alias("lo"), F.max(finite).alias("hi")))
    labelled = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), rule(F.col("n")).cast("long").alias("rank")) for label, rule in ranks.items()])).alias("_l")
    asked = groups.select("*", labelled).select(*ks, "n", "_l.label", "_l.rank", "a", "b", "lo", "hi", F.col("n").alias("c"))
    # c rows lie in [a, b]; rank counts from the first of them.
    open_ = asked.filter((F.col("rank") >= 1) & (F.col("rank") <= F.col("n")))
    names = [f"_r{k}" for k in ks]
    answer = [*ks, "label", "val"]

    def ranges(of: DataFrame) -> DataFrame:
        return of.select(*[F.col(k).alias(r) for k, r in zip(ks, names, strict=True)], "a", "b", "lo", "hi").distinct()

    def within(of: DataFrame) -> DataFrame:
        return rows.join(ranges(of), _all_same(ks, names) & (F.col("_v") >= F.col("a")) & (F.col("_v") <= F.col("b")))

    def looked_up(of: DataFrame, parts: DataFrame) -> DataFrame:
        """The ranks of ``of`` with the part that holds each."""
        named = parts.select(*[F.col(k).alias(r) for k, r in zip(ks, names, strict=True)], F.col("a").alias("_a"), "parts")
        joined = of.join(named, _all_same([*ks, "a"], [*names, "_a"]))
        return joined.select(*ks, "n", "label", "rank", "lo", "hi", _holding(F.col("parts"), F.col("rank")).alias("hit"))

    def settled(of: DataFrame) -> DataFrame:
        counted = within(of).groupBy(*ks, "a", "_v").agg(F.count(F.lit(1)).alias("c"))
        parts = counted.groupBy(*ks, "a").agg(F.sort_array(F.collect_list(F.struct("_v", "c"))).alias("parts"))
        return looked_up(of, parts).select(*ks, "label", F.col("hit.part._v").alias("val"))

    done = [open_.filter("a <=> b").select(*ks, "label", F.col("a").alias("val"))]
    open_ = open_.filter("not a <=> b")
    for _ in range(ROUNDS):
        large = open_.filter(F.col("c") > max_rows)
        if not large.take(1):
            large = None
            break
        done.append(settled(open_.filter(F.col("c") <= max_rows)))
        cells = within(large).groupBy(*ks, "a", _cell(F.col("_v"), F.col("lo"), F.col("hi")).alias("cell")).agg(
            F.count(F.lit(1)).alias("c"), F.min("_v").alias("first"), F.max("_v").alias("last"))
        parts = cells.groupBy(*ks, "a").agg(F.sort_array(F.collect_list(F.struct("cell", "c", "first", "last"))).alias("parts"))
        found = cut_lineage(looked_up(large, parts).select(
            *ks, "n", "label", (F.col("rank") - F.col("hit.before")).alias("rank"), F.col("hit.part.first").alias("a"), F.col("hit.part.last").alias("b"),
            F.col("hit.part.first").cast("double").alias("lo"), F.col("hit.part.last").cast("double").alias("hi"), F.col("hit.part.c").alias("c")))
        done.append(found.filter("a <=> b").select(*ks, "label", F.col("a").alias("val")))
        open_ = found.filter("not a <=> b")
    else:
        large = open_.filter(F.col("c") > max_rows)
        large = large if large.take(1) else None
    done.append(settled(open_.filter(F.col("c") <= max_rows)))
    if large is not None:
        counted = within(large).groupBy(*ks, "a", "_v").agg(F.count(F.lit(1)).alias("_c"))
        placed = running_sum(counted, [*ks, "a"], ["_v"], "_c", "_cum").select(*[F.col(k).alias(r) for k, r in zip(ks, names, strict=True)], F.col("a").alias("_a"), "_v", "_c", "_cum")
        hit = (F.col("_cum") - F.col("_c") < F.col("rank")) & (F.col("rank") <= F.col("_cum"))
        done.append(large.join(placed, _all_same([*ks, "a"], [*names, "_a"]) & hit).select(*ks, "label", F.col("_v").alias("val")))
    values = reduce(DataFrame.unionByName, [d.select(*answer) for d in done])
    # Groups come along without a label, for their sizes.
    every = values.withColumn("n", F.lit(None).cast("long")).unionByName(groups.select(*ks, F.lit("").alias("label"), F.col("a").alias("val"), "n"))
    picked = [F.max(F.when(F.col("n").isNull() & (F.col("label") == label), F.col("val"))).alias(label) for label in ranks]
    out = every.groupBy(*ks).agg(F.max("n").alias("n"), *picked)
    return out.select(*[F.col(k).alias(c) for c, k in zip(group, ks)], "n", *ranks)  # noqa: B905


def lower_median(n: Column) -> Column:
    return F.floor((n + 1) / 2)


def upper_median(n: Column) -> Column:
    return F.ceil((n + 1) / 2)


def median_from(lo: Column, hi: Column) -> Column:
    return (lo.cast("double") + hi.cast("double")) / 2


def linear_ranks(label: str, p: float) -> dict[str, RankRule]:
    """Neighbours of the linear-interpolation position (n-1)p."""
    return {
        f"{label}_lo": lambda n: F.floor((n - 1) * F.lit(p)) + 1,
        f"{label}_hi": lambda n: F.ceil((n - 1) * F.lit(p)) + 1,
    }


def linear_value(label: str, p: float) -> Column:
    h = (F.col("n") - 1) * F.lit(p)
    frac = h - F.floor(h)
    lo, hi = F.col(f"{label}_lo").cast("double"), F.col(f"{label}_hi").cast("double")
    return lo + (hi - lo) * frac


def nearest_rank(pct: float) -> RankRule:
    """Nearest rank with halves rounded to the even position."""
    return lambda n: F.bround(F.lit(pct / 100.0) * (n - 1), 0).cast("long") + 1


def exclusive_ranks(label: str, p: float) -> dict[str, RankRule]:
    """Neighbours of the exclusive position p(n+1), kept inside 1..n."""
    def clamp(n: Column, c: Column) -> Column:
        return F.greatest(F.lit(1).cast("long"), F.least(n, c))
    return {
        f"{label}_lo": lambda n: clamp(n, F.greatest(F.lit(1), F.least(n - 1, F.floor((n + 1) * F.lit(p))))),
        f"{label}_hi": lambda n: clamp(n, F.greatest(F.lit(1), F.least(n - 1, F.floor((n + 1) * F.lit(p)))) + 1),
    }


def exclusive_value(label: str, p: float) -> Column:
    """Interpolated quantile; fewer than two values give the value itself."""
    n = F.col("n")
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor((n + 1) * F.lit(p))))
    delta = (n + 1) * F.lit(p) - j
    lo, hi = F.col(f"{label}_lo").cast("double"), F.col(f"{label}_hi").cast("double")
    return F.when(n < 2, lo).otherwise(lo * (1 - delta) + hi * delta)


def decile_low(n: Column) -> Column:
    """Rank of the low decile: index max(0, floor(n/10) - 1)."""
    return F.greatest(F.lit(0), F.floor(F.lit(0.10) * n) - 1) + 1


def decile_high(n: Column) -> Column:
    """Rank of the high decile: index min(n-1, floor(0.9 n))."""
    return F.least(n - 1, F.floor(F.lit(0.90) * n)) + 1


def describe(df: DataFrame, group: list[str], value: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """n, mean, median, min, max, population std and low/high decile per group.

    Groups whose values are all null stay, with n = 0 and null statistics.
    """
    keys = group or ["_all"]
    base = df if group else df.withColumn("_all", F.lit(0))
    v = F.col(value).cast("double")
    agg = base.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.stddev_pop(v).alias("std"),
    )
    stats = order_stats(base, keys, value, {
        "_m1": lower_median, "_m2": upper_median, "p10": decile_low, "p90": decile_high,
    }, max_rows).drop("n")
    renamed = stats.select(*[F.col(k).alias(f"_o_{k}") for k in keys], "_m1", "_m2", "p10", "p90")
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_o_{k}"))
        cond = c if cond is None else cond & c
    out = agg.join(renamed, cond, "left").select(
        *keys, "n", "mean", median_from(F.col("_m1"), F.col("_m2")).alias("median"),
        "min", "max", "std", F.col("p10").cast("double").alias("p10"), F.col("p90").cast("double").alias("p90"),
    )
    return out if group else out.drop("_all")
