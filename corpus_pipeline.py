"""Corpus pipeline: toxicity, line dedup, n-gram join, mixing, packing.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as
the ``docs`` of the next one. All stages but the last return the columns of
documents. What a stage decides holds for the next: toxic documents are gone,
repeated lines are cut, one document of every near-duplicate group is left,
small sources are repeated up to twice (no document is dropped by mixing), and
all that is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pandekt.llm import line_dedup, mixing, ngram_join, packing, toxicity
from pandekt.llm.common import cut, table
from pandekt.llm.tokens import default_path
from pandekt.operators.ordered import row_positions

#: Cached pieces per worker: fewer than alone, for the workers of other stages hold memory, too.
PIECES = 200_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold, unchanged."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(COLUMNS), model, carry=("lang", "source", "n_chars"))
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are kept elsewhere; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8.

    Rows that share an id, or have none, are documents of their own: they are
    numbered by id (null first) and text, and the first of a group stays.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").take(1):
        hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"))
        keyed = cut(row_positions(hashed, [], ["doc_id", "_hash"], "_key"), "numbered")
    else:
        keyed = docs.withColumn("_key", F.col("doc_id"))
    joined = ngram_join.ngram_join(keyed, doc_id="_key", words=5, per_cent=80)
    gone = joined.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_key"))
    return keyed.join(gone, "_key", "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them: every one at least once, none more than twice."""
    return mixing.mixed_documents(docs, repeat_limit=2.0).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of all documents in windows of 2,048 tokens."""
    return packing.pack_documents(docs, default_path(), with_ids=False, cache_entries=PIECES).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned scores and byte-pair ids have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
