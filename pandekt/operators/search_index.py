"""A stored search index: blocked postings, word frequencies, statistics and vectors of a corpus.

Built once, searched many times: a search reads the postings of the asked words
and the vectors, never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pandekt.operators.embedding import embed
from pandekt.operators.postings import block_frequencies, block_stats, posting_blocks
from pandekt.session import cut_lineage

PARTS = ("postings", "frequencies", "stats", "vectors")
#: Bytes of a row group of postings: the unit that a filter on words skips.
ROW_GROUP = 1 << 20


@dataclass(frozen=True)
class SearchIndex:
    """postings (see ``posting_blocks``), frequencies(term, df), stats(n_docs, total), vectors(chunk_id, doc_urn, vec)."""

    postings: DataFrame
    frequencies: DataFrame
    stats: DataFrame
    vectors: DataFrame


def write_postings(blocks: DataFrame, path: str, row_group: int = ROW_GROUP) -> None:
    """Block table in ranges of (term, shard): a word lies in one row group or in neighbours, a frequent one is spread over files."""
    ranged = blocks.repartitionByRange("term", "shard").sortWithinPartitions("term", "shard")
    ranged.write.mode("overwrite").option("parquet.block.size", str(row_group)).parquet(path)


def build_index(chunks: DataFrame, path: str, chunk_id: str = "chunk_id", text: str = "text", doc_urn: str = "doc_urn", encoder=None) -> SearchIndex:
    """Write the index of ``chunks`` below ``path`` (overwriting it) and open it."""
    spark = chunks.sparkSession
    c = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(doc_urn).alias("doc_urn"), F.col(text).alias("text"))
    # Written before it is sorted into ranges: shard names must not be drawn again.
    write_postings(cut_lineage(posting_blocks(c)), f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    block_frequencies(postings).write.mode("overwrite").parquet(f"{path}/frequencies")
    block_stats(postings).write.mode("overwrite").parquet(f"{path}/stats")
    embed(c, encoder=encoder).select("chunk_id", "doc_urn", "vec").write.mode("overwrite").parquet(f"{path}/vectors")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(*(spark.read.parquet(f"{path}/{p}") for p in PARTS))
