"""Registry of the runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pandekt.session import prepare, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


SPREAD_KEYS = {"documents": "doc_id", "pages": "page_id", "lineitem": "l_orderkey"}


class Tables:
    """Input tables of one data folder, read lazily by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # Large tables that come as one small file are read by all cores.
        return spread(df, SPREAD_KEYS[name]) if name in SPREAD_KEYS else df


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``, with equivalent SQL if there is one."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap
