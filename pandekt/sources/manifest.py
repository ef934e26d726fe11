"""Reading listed sources, lookups and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scan_manifest(manifest: DataFrame, files: DataFrame, key: str = "key") -> DataFrame:
    """Every listed source with its status; a missing one is reported, the rest proceeds.

    ``files`` may hold many rows per source; they are counted before the join.
    """
    found = files.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return manifest.join(found, key, "left").withColumn(
        "status", F.when(F.col("n_rows").isNull(), "missing").otherwise("read")).withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))


def read_listed(files: DataFrame, manifest: DataFrame, key: str = "key") -> DataFrame:
    """Rows of the listed sources only, with the manifest columns attached."""
    return files.join(manifest, key)


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Raw files below ``path``: (path, raw bytes, size)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select(
        "path", F.col("content").alias("raw"), F.col("length").alias("size"))


def scan_projection(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Full scan of a table returning only the named fields (pruned in Parquet)."""
    return spark.read.parquet(path).select(*fields)


def lookup_by_id(ids: DataFrame, table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Fetch by id; ids without a row give empty text."""
    return ids.join(table.select(key, F.col(text)), key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def orphans(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return ids.select(key).distinct().join(table.select(key), key, "left_anti")


def lookup_strict(ids: DataFrame, table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Fetch by id; fails naming (some of) the ids without a row."""
    bad = [r[0] for r in orphans(ids, table, key).limit(20).collect()]
    if bad:
        raise KeyError(f"ids without a row, for example: {bad}")
    return ids.join(table.select(key, F.col(text)), key)


MIN_HTML_SIZE = 10_000


def reject_reason(content_type: Column, raw: Column, min_size: int = MIN_HTML_SIZE) -> Column:
    """Why a downloaded page is not accepted; null when it is.

    A missing content type is tolerated.
    """
    primary = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    head = F.lower(F.substring(F.regexp_replace(raw, r"^\s+", ""), 1, 200))
    return (
        F.when((F.coalesce(primary, F.lit("")) != "") & ~primary.startswith("text/html"), "content_type")
        .when(F.octet_length(raw) < min_size, "too_small")
        .when(~(head.startswith("<!doctype") | head.startswith("<html")), "not_html")
    )


def content_gate(pages: DataFrame, content_type: str, raw: str, min_size: int = MIN_HTML_SIZE) -> DataFrame:
    return pages.withColumn("reject_reason", reject_reason(F.col(content_type), F.col(raw), min_size))


def extract_link(html: Column, pattern: str, base: str) -> Column:
    """First matching href, unescaped and absolute; null when there is none."""
    href = F.regexp_extract(html, pattern, 1)
    for entity, ch in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        href = F.replace(href, F.lit(entity), F.lit(ch))
    return F.when(href == "", F.lit(None)).when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href)
