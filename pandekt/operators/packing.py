"""Order-preserving greedy packing of paragraphs into token-budgeted groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pandekt.operators.ordered import ordered_blocks, split_hot

THRESHOLD = 2000
MAX_ARTICLE = 100_000
#: Items folded before their group starts are appended to those of the article, which copies them.
FOLD_RUN = 512


def group_starts(tokens: Column, threshold: int) -> Column:
    """0-based start of every group for one ordered array of token counts.

    A group is closed when it holds something and the next item would push it
    over the threshold; an item above the threshold therefore stands alone.
    """
    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), none.alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        opens = (acc["i"] == 0) | (acc["sum"] + x.cast("double") > threshold)
        return F.struct(
            F.when(opens, x.cast("double")).otherwise(acc["sum"] + x.cast("double")).alias("sum"),
            (acc["i"] + 1).alias("i"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    def run(acc: Column, k: Column) -> Column:
        begin = F.struct(acc["sum"].alias("sum"), acc["i"].alias("i"), none.alias("starts"))
        part = F.aggregate(F.slice(tokens, k * FOLD_RUN + 1, F.lit(FOLD_RUN)), begin, step)
        return F.get(F.transform(F.array(part), lambda p: F.struct(
            p["sum"].alias("sum"), p["i"].alias("i"), F.concat(acc["starts"], p["starts"]).alias("starts"))), F.lit(0))

    runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(tokens) / FOLD_RUN).cast("int") - 1, F.lit(0)))
    return F.aggregate(runs, zero, run)["starts"]


def slices(items: Column, starts: Column) -> Column:
    """Cut an array at the given starts."""
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(items)))
    return F.zip_with(starts, ends, lambda s, e: F.slice(items, s + 1, e - s))


def pack_greedy(df: DataFrame, article: list[str], order: list[str], tokens: str, threshold: int = THRESHOLD,
                max_article: int = MAX_ARTICLE, block_rows: int = 250_000) -> DataFrame:
    """Add ``group_index`` to every row; rows of an article are packed in ``order``.

    Articles up to ``max_article`` rows are folded as one array each. Larger
    ones are cut into ordered blocks: every block reports where a packing that
    enters with a given partial sum would leave it, the blocks of an article
    chained on those short summaries, and each block is then labelled on
    its own. Token counts are whole numbers: a fraction is an error, since sums
    of fractions would depend on how an article is cut into blocks.
    """
    count = F.col(tokens).cast("double")
    whole = F.when(count != F.floor(count), F.raise_error(F.lit("token counts must be whole numbers"))).otherwise(F.col(tokens))
    df = df.select(*article, *order, whole.cast(df.schema[tokens].dataType).alias(tokens))
    cold, hot = split_hot(df, article, max_article)
    packed = cold.groupBy(*article).agg(
        F.array_sort(F.collect_list(F.struct(*order, F.col(tokens).alias("_x")))).alias("_items"),
    ).select(*article, "_items", group_starts(F.transform("_items", lambda s: s["_x"]), threshold).alias("_starts"))
    out = packed.select(*article, F.posexplode(slices(F.col("_items"), F.col("_starts"))).alias("group_index", "_g")).select(
        *article, "group_index", F.inline("_g"),
    ).withColumnRenamed("_x", tokens).select(*article, *order, tokens, "group_index")
    if hot is None:
        return out
    return out.unionByName(_pack_blocks(hot, article, order, tokens, threshold, block_rows))


def _next_start(prefix: np.ndarray, threshold: int) -> np.ndarray:
    """Per item: start of the following group if a group starts there (len = none)."""
    m = len(prefix) - 1
    j = np.searchsorted(prefix, prefix[:-1] + threshold, side="right") - 1
    return np.minimum(np.maximum(j, np.arange(m) + 1), m)


def _first_break(prefix: np.ndarray, carry: float, threshold: int) -> int:
    """First item that no longer fits a group entering the block with ``carry``."""
    return int(np.searchsorted(prefix, threshold - carry, side="right")) - 1 if carry <= threshold else 0


def _pack_blocks(hot: DataFrame, article: list[str], order: list[str], tokens: str, threshold: int, block_rows: int) -> DataFrame:
    b = ordered_blocks(hot, article, order, block_rows)
    keys = [*article, "_block"]
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in b.select(*keys).schema)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[tokens].to_numpy(dtype=np.float64)
        p = np.r_[0.0, np.cumsum(x)]
        nxt, m = _next_start(p, threshold), len(x)
        left, opened = np.zeros(m + 1), np.zeros(m + 1, dtype=np.int64)
        for i in range(m - 1, -1, -1):
            j = nxt[i]
            left[i] = p[m] - p[i] if j >= m else left[j]
            opened[i] = 1 + opened[j]
        w = min(m, int(np.searchsorted(p, threshold, side="right")) + 1)
        row = pdf[keys].iloc[:1].copy()
        row["total"] = p[m]
        row["prefix"], row["left"], row["opened"] = [p[1:w + 1].tolist()], [left[:w].tolist()], [opened[:w].tolist()]
        return row

    summary = b.groupBy(*keys).applyInPandas(
        summarise, f"{key_fields}, total double, prefix array<double>, left array<double>, opened array<bigint>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        carry, index, fresh, carries, indexes = 0.0, 0, True, [], []
        for total, prefix, left, opened in zip(pdf["total"], pdf["prefix"], pdf["left"], pdf["opened"]):
            carries.append(-1.0 if fresh else carry)
            indexes.append(index)
            at = 0 if fresh else _first_break(np.r_[0.0, np.asarray(prefix)], carry, threshold)
            if at < len(left):
                carry, index = left[at], index + int(opened[at])
            else:
                carry += total
            fresh = False
        return pdf[keys].assign(_carry=carries, _index=indexes)

    entry = summary.groupBy(*article).applyInPandas(chain, f"{key_fields}, _carry double, _index bigint")
    fields = b.select(*article, *order, tokens).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", group_index int"

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[tokens].to_numpy(dtype=np.float64)
        p = np.r_[0.0, np.cumsum(x)]
        nxt, m = _next_start(p, threshold), len(x)
        carry, index = pdf["_carry"].iloc[0], int(pdf["_index"].iloc[0])
        at = 0 if carry < 0 else _first_break(p, carry, threshold)
        marks = np.zeros(m, dtype=np.int64)
        while at < m:
            marks[at] = 1
            at = nxt[at]
        # Entering groups are numbered from the last one opened before the block.
        return pdf[[*article, *order, tokens]].assign(group_index=(index - 1 + np.cumsum(marks)).astype("int32"))

    joined = b.join(entry, keys)
    return joined.groupBy(*keys).applyInPandas(label, schema)
