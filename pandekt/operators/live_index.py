"""A stored BM25 index kept up to date batch by batch.

A batch adds a folder: a forward table (which words a chunk has and where it
stands in the blocks; a removed chunk stands nowhere), posting blocks of its
chunks, tombstones for the places of the chunks it replaces, and signed changes
of word frequencies and corpus size. The head of the index names the folders in
order and the last batch taken in. A search adds the changes up and skips
tombstones, so its hits and scores are those of an index built anew. Now and then
the folders are folded into one.

Words are shuffled once, to tell rows of one id apart, and written once, with
their places. Replaced chunks are found by ids and places alone; their words are
then picked out where they lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pandekt.functions.text import words
from pandekt.operators.ordered import top_k
from pandekt.operators.postings import SHARD_ROWS, block_frequencies, block_stats, blocks_of_places, placed, search_blocks
from pandekt.operators.search_index import write_postings
from pandekt.sources import versions

FOLD_AFTER = 16
#: Up to so many places (checked by a count) travel with the tasks that pick words out of the forward table.
SENT_PLACES = 1 << 19


class LiveIndex:
    """The index at ``path`` as of one version; ``upsert`` returns the next one."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.version, content = versions.head(spark, path, version)
        self.folders: list[str] = content.get("folders", [])
        #: Last batch taken in from every stream that writes here.
        self.last_batch: dict[str, int] = content.get("last_batch", {})

    def _read(self, part: str) -> DataFrame | None:
        frames = [self.spark.read.parquet(f"{self.path}/{f}/{part}") for f in self.folders]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def upsert(self, batch: DataFrame, batch_id: int | None = None, order: list[str] | None = None, fold_after: int = FOLD_AFTER, shard_rows: int = SHARD_ROWS, source: str = "") -> LiveIndex:
        """Take in chunks (chunk_id, doc_urn, text); a known id is replaced, a null text removes the chunk.

        A batch id that was taken in from ``source`` already changes nothing, so a
        stream may deliver a batch again; its checkpoint names the source. Of rows
        with one id the last by ``order`` counts.
        """
        if batch_id is not None and batch_id <= self.last_batch.get(source, -1):
            return self
        fresh = top_k(batch, ["chunk_id"], [F.desc(c) for c in order], 1, "_i") if order else batch.dropDuplicates(["chunk_id"])
        fresh = fresh.select("chunk_id", F.col("doc_urn").cast("string").alias("doc_urn"), words(F.col("text")).alias("w"))
        self._add(fresh, [*self.folders], self.last_batch if batch_id is None else self.last_batch | {source: batch_id}, shard_rows)
        grown = LiveIndex(self.spark, self.path)
        return grown.fold(shard_rows) if len(grown.folders) > fold_after else grown

    def _alive(self, only: DataFrame | None = None) -> DataFrame | None:
        """Forward rows whose place has no tombstone, of the chunks in ``only`` if given."""
        forward = self._read("forward")
        if forward is None:
            return None
        forward = forward.filter(F.col("shard").isNotNull())
        if only is not None:
            # First, so that tombstones meet these chunks and no others.
            forward = forward.join(only, "chunk_id", "left_semi")
        return forward.join(self._read("dead"), ["shard", "pos"], "left_anti")

    def _picked(self, places: DataFrame, inside: bool) -> DataFrame:
        """Forward rows whose place is among ``places`` (shard, pos), or is not; words are shuffled only for more than ``SENT_PLACES``."""
        forward = self._read("forward").filter(F.col("shard").isNotNull())
        if places.count() > SENT_PLACES:
            return forward.join(places, ["shard", "pos"], "left_semi" if inside else "left_anti")
        lists = F.broadcast(places.groupBy("shard").agg(F.collect_list("pos").alias("_at")))
        met = F.coalesce(F.array_contains("_at", F.col("pos")), F.lit(False))
        return forward.join(lists, "shard", "inner" if inside else "left").filter(met if inside else ~met).drop("_at")

    def _add(self, chunks: DataFrame, folders: list[str], taken: dict[str, int], shard_rows: int) -> None:
        """Publish ``folders`` and one more, of chunks (chunk_id, doc_urn, w; null: removed) that replace those of ``folders``."""
        spark, folder = self.spark, versions.new_folder(self.path)
        rows = placed(chunks.select(F.col("chunk_id").alias("id"), F.col("doc_urn").alias("urn"), "w"), shard_rows)
        rows.select(F.col("id").alias("chunk_id"), F.col("urn").alias("doc_urn"), "dl", "w", "shard", "pos").write.option("compression", "zstd").parquet(f"{folder}/forward")
        forward = spark.read.parquet(f"{folder}/forward")
        living = forward.filter(F.col("shard").isNotNull())
        # Made twice, to sample the ranges and to fill them: with places given they are the same, and a copy would cost more.
        write_postings(blocks_of_places(living.withColumnsRenamed({"chunk_id": "id", "doc_urn": "urn"})), f"{folder}/postings")
        postings = spark.read.parquet(f"{folder}/postings")
        old = self._alive(forward.select("chunk_id")) if folders else living.limit(0)
        old.select("shard", "pos").write.parquet(f"{folder}/dead")
        changes, sizes = block_frequencies(postings), block_stats(postings)
        if folders:
            dead = spark.read.parquet(f"{folder}/dead")
            gone = self._picked(dead, True)
            changes = changes.unionByName(gone.select(F.explode(F.array_distinct("w")).alias("term"), F.lit(-1).cast("long").alias("df")))
            sizes = sizes.unionByName(gone.select(F.lit(-1).cast("long").alias("n_docs"), (-F.col("dl")).alias("total")))
        changes.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").write.parquet(f"{folder}/frequencies")
        sizes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "total")]).write.parquet(f"{folder}/stats")
        versions.publish(spark, self.path, self.version + 1, {"folders": [*folders, folder.rsplit("/", 1)[1]], "last_batch": taken})

    def fold(self, shard_rows: int = SHARD_ROWS) -> LiveIndex:
        """All folders as one, without what tombstones hide; no text is read."""
        if self.folders:
            self._add(self._picked(self._read("dead"), False).select("chunk_id", "doc_urn", "w"), [], self.last_batch, shard_rows)
        return LiveIndex(self.spark, self.path)

    def stats(self) -> DataFrame:
        return self._read("stats").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total"))

    def frequencies(self) -> DataFrame:
        return self._read("frequencies").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def search(self, queries: DataFrame, k: int, filter_doc: str | None = None, digits: int = 6) -> DataFrame:
        """Top k of (qid, text) by BM25 over the chunks of this version: qid, rank, chunk_id, score."""
        if k <= 0:
            raise ValueError(f"k must be > 0 (got {k})")
        want = F.col(filter_doc).cast("string") if filter_doc else F.lit(None).cast("string")
        asked = queries.select("qid", want.alias("want"), F.array_distinct(F.coalesce(words(F.col("text")), F.array())).alias("terms"))
        if not self.folders:
            raise FileNotFoundError(f"no index at {self.path}")
        dead = self._read("dead").groupBy("shard").agg(F.collect_list("pos").alias("dead"))
        scored = search_blocks(asked, self._read("postings"), k, self.frequencies(), self.stats(), bool(filter_doc), digits, dead=dead)
        return top_k(scored, ["qid"], [F.desc("score"), F.asc("chunk_id")], k).select("qid", "rank", "chunk_id", "score")
