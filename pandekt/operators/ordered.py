"""Running computations over ordered groups that may be arbitrarily large.

A window partition is processed by one task. Groups up to ``max_group`` rows
take that plan. Larger ("hot") groups are range-partitioned on (group, order)
into contiguous blocks: each block is processed on its own, the per-block
results (one row per block) are carried over, and joined back. Both paths give
the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType, FractionalType

from pandekt.session import cut_lineage

MAX_GROUP = 1_000_000


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def hot_groups(df: DataFrame, group: list[str], max_group: int = MAX_GROUP) -> DataFrame:
    """Keys of the groups with more than ``max_group`` rows."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_group).drop("_n")


def split_hot(df: DataFrame, group: list[str], max_group: int = MAX_GROUP) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups or None).

    Runs one aggregation to find out whether hot groups exist at all. A whole
    table as one group (``group`` empty) is hot when it exceeds the limit.
    """
    if not group:
        big = len(df.select(F.lit(1)).limit(max_group + 1).groupBy().count().filter(F.col("count") > max_group).take(1)) > 0
        return (df.limit(0), df) if big else (df, None)
    hot = hot_groups(df, group, max_group)
    if not hot.take(1):
        return df, None
    hot = cut_lineage(hot)
    keys = hot.select(*[F.col(k).alias(f"_h_{k}") for k in group])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in group])
    return df.join(keys, cond, "left_anti"), df.join(keys, cond, "left_semi")


def ordered_blocks(df: DataFrame, group: list[str], order: list[str], block_rows: int) -> DataFrame:
    """Add ``_block``: contiguous ranges in (group, order), fixed by writing them.

    Rows equal in (group, order) share a block, so ``order`` should be a total
    order. The number of blocks follows the row count.
    """
    n = df.count()
    parts = max(1, -(-n // block_rows))
    cols = [F.col(c) for c in [*group, *order]]
    ranged = df.repartitionByRange(parts, *cols).withColumn("_block", F.spark_partition_id())
    return cut_lineage(ranged)


def _window(group: list[str], order: list[str]):
    w = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    return w.orderBy(*[F.col(c) for c in order])


def row_positions(df: DataFrame, group: list[str], order: list[str], name: str = "pos",
                  max_group: int = MAX_GROUP, block_rows: int = 250_000) -> DataFrame:
    """1-based position of every row inside its group."""
    cold, hot = split_hot(df, group, max_group)
    out = cold.withColumn(name, F.row_number().over(_window(group, order)).cast("long"))
    if hot is None:
        return out
    b = ordered_blocks(hot, group, order, block_rows)
    sizes = b.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn(
        "_before", F.coalesce(F.sum("_n").over(_window(group, ["_block"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_n")
    local = b.withColumn("_rn", F.row_number().over(_window([*group, "_block"], order)))
    joined = local.join(before, _same(local, before, [*group, "_block"])).select(
        *[local[c] for c in df.columns], (local["_rn"] + before["_before"]).cast("long").alias(name),
    )
    return out.unionByName(joined)


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, name: str,
                max_group: int = MAX_GROUP, block_rows: int = 250_000) -> DataFrame:
    """Sum of ``value`` from the start of the group up to and including the row.

    Fractions are added as decimals of 12 places and given back as doubles:
    decimal sums don't depend on how a group is cut into blocks.
    """
    if isinstance(df.schema[value].dataType, FractionalType) and not isinstance(df.schema[value].dataType, DecimalType):
        exact = df.withColumn("_exact", F.col(value).cast("decimal(38,12)"))
        total = running_sum(exact, group, order, "_exact", name, max_group, block_rows)
        return total.withColumn(name, F.col(name).cast("double")).drop("_exact")
    cold, hot = split_hot(df, group, max_group)
    upto = _window(group, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cold.withColumn(name, F.sum(value).over(upto))
    if hot is None:
        return out
    b = ordered_blocks(hot, group, order, block_rows)
    sums = b.groupBy(*group, "_block").agg(F.sum(value).alias("_s"))
    before = sums.withColumn(
        "_before", F.coalesce(F.sum("_s").over(_window(group, ["_block"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_s")
    local = b.withColumn(
        "_run", F.sum(value).over(_window([*group, "_block"], order).rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    joined = local.join(before, _same(local, before, [*group, "_block"])).select(
        *[local[c] for c in df.columns], (local["_run"] + before["_before"]).alias(name),
    )
    return out.unionByName(joined)


def carry_forward(df: DataFrame, group: list[str], order: list[str], values: dict[str, str],
                  max_group: int = MAX_GROUP, block_rows: int = 250_000) -> DataFrame:
    """Last non-null value so far: ``values`` maps source column to result column."""
    cold, hot = split_hot(df, group, max_group)
    upto = _window(group, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cold.select("*", *[F.last(src, ignorenulls=True).over(upto).alias(dst) for src, dst in values.items()])
    if hot is None:
        return out
    b = ordered_blocks(hot, group, order, block_rows)
    in_block = _window([*group, "_block"], order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.select("*", *[F.last(src, ignorenulls=True).over(in_block).alias(f"_l_{dst}") for src, dst in values.items()])
    ordering = F.struct(*[F.col(c) for c in order])
    ends = b.groupBy(*group, "_block").agg(
        *[F.max_by(F.col(src), F.when(F.col(src).isNotNull(), ordering)).alias(f"_e_{dst}") for src, dst in values.items()]
    )
    earlier = _window(group, ["_block"]).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(
        *group, "_block", *[F.last(f"_e_{dst}", ignorenulls=True).over(earlier).alias(f"_b_{dst}") for dst in values.values()]
    )
    joined = local.join(before, _same(local, before, [*group, "_block"])).select(
        *[local[c] for c in df.columns],
        *[F.coalesce(local[f"_l_{dst}"], before[f"_b_{dst}"]).alias(dst) for dst in values.values()],
    )
    return out.unionByName(joined)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of every group, ranked from 1.

    Spark limits each group before the shuffle as well (WindowGroupLimit), so
    a hot group sends at most k rows per map task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    cut = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return cut.withColumn(name, F.col(name).cast("long"))
