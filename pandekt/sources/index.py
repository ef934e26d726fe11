"""The chunk index as a table: idempotent upsert, nested JSON results, graph links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pandekt.functions.ids import point_id
from pandekt.operators.ordered import top_k
from pandekt.sources import versions

PAYLOAD = ["chunk_id", "text", "source_type", "chunk_type", "doc_urn", "article_eid", "para_eids", "hierarchy_path", "metadata"]


def with_point_id(chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    return chunks.withColumn("point_id", point_id(F.col(chunk_id)))


def latest(new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``."""
    return top_k(new, [key], [F.desc(c) for c in order], 1, "_i").drop("_i")


def merge_upsert(existing: DataFrame, new: DataFrame, key: str = "point_id", order: list[str] | None = None) -> DataFrame:
    """Existing rows overwritten by new ones with the same key.

    Only the keys of ``new`` meet the existing rows (an anti join), so a small
    batch is broadcast and the big table is not shuffled.
    """
    fresh = latest(new, key, order) if order else new.dropDuplicates([key])
    kept = existing.join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh.select(*existing.columns))


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The index table at ``path``, as it was when this was called (or at an earlier ``version``)."""
    found, content = versions.head(spark, path, version)
    if not found:
        raise FileNotFoundError(f"no index at {path}")
    schema = StructType.fromJson(content["schema"])
    folders: dict[str, list[str]] = {}
    for part, folder in content["parts"].items():
        folders.setdefault(folder, []).append(part)
    if not folders:
        return spark.createDataFrame([], schema)
    root = path.rstrip("/")
    # One scan per version that still holds partitions; each sees only those it holds.
    scans = [spark.read.schema(schema).option("basePath", f"{root}/{f}").parquet(*[f"{root}/{f}/{p}" for p in parts]) for f, parts in sorted(folders.items())]
    return reduce(DataFrame.unionByName, [s.select(*schema.names) for s in scans])


def upsert_index(spark: SparkSession, path: str, new: DataFrame, mode: str = "ensure", key: str = "point_id",
                 partition: str = "doc_urn", order: list[str] | None = None) -> int:
    """Write ``new`` into the index table at ``path``; returns the number of upserted rows.

    ``ensure`` keeps existing rows, ``reset`` starts empty. Data is laid out by
    ``partition``; the partitions touched by the batch are written to a new
    folder and the next version names them there and the others where they
    are. Readers see a version or the next, never a part of it; of two writers
    at the same time one raises ``VersionTaken``. A key must always map to the
    same partition, which holds for ids derived from the document. Running the
    same batch again gives the same table.
    """
    if mode not in ("ensure", "reset"):
        raise ValueError(f"mode must be 'ensure' or 'reset' (got {mode!r})")
    fresh = (latest(new, key, order) if order else new.dropDuplicates([key])).persist()
    try:
        count = fresh.count()
        version, content = versions.head(spark, path)
        kept: dict[str, str] = {}
        rows = fresh
        if mode == "ensure" and version:
            if count == 0:
                return 0
            kept = dict(content["parts"])
            existing = read_index(spark, path, version)
            touched = existing.join(fresh.select(partition).distinct(), partition, "left_semi")
            rows = merge_upsert(touched, fresh.select(*existing.columns), key)
        folder = versions.new_folder(path)
        _laid_out(rows, partition).write.mode("errorifexists").partitionBy(partition).parquet(folder)
        name = folder.rsplit("/", 1)[1]
        kept.update(dict.fromkeys(versions.folders_in(spark, folder), name))
        schema = StructType([f for f in rows.schema if f.name != partition] + [rows.schema[partition]])
        versions.publish(spark, path, version + 1, {"parts": kept, "schema": schema.jsonValue()})
        return count
    finally:
        fresh.unpersist()


def _laid_out(df: DataFrame, partition: str) -> DataFrame:
    """Rows of a partition brought together for writing, so files stay few.

    A rebalance, unlike a repartition, lets adaptive execution split a
    partition that holds a large part of the table over several tasks.
    """
    return df.hint("rebalance", F.col(partition))


def nest_results(hits: DataFrame, key: str = "qid", depth: int | None = None) -> DataFrame:
    """One nested row per question: its hits ordered by rank (the first ``depth``, if given)."""
    h = hits if depth is None else hits.filter(F.col("rank") <= depth)
    return h.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("top"))


def write_nested(nested: DataFrame, path: str) -> int:
    """Write nested JSON as the next version at ``path``; readers switch from the old result to the new one at once."""
    spark = nested.sparkSession
    version = versions.head(spark, path)[0] + 1
    folder = versions.new_folder(path)
    nested.write.mode("errorifexists").json(folder)
    versions.publish(spark, path, version, {"folder": folder.rsplit("/", 1)[1]})
    return version


def read_nested(spark: SparkSession, path: str, key_type: str = "string", id_type: str = "string", key: str = "qid", version: int | None = None) -> DataFrame:
    """Nested result files back to flat hits, with an explicit schema."""
    found, content = versions.head(spark, path, version)
    if not found:
        raise FileNotFoundError(f"no results at {path}")
    raw = spark.read.schema(f"{key} {key_type}, top array<struct<rank:bigint,chunk_id:{id_type},score:double>>").json(f"{path.rstrip('/')}/{content['folder']}")
    return raw.select(key, F.inline("top"))


# Relations and origins a graph link may have.
RELATIONS = ["complementare", "presupposto_di", "rinvia_a", "attua", "deroga"]
ORIGINS = ["curated", "auto"]
LINK_FIELDS = ["from", "to", "relation", "note", "source", "validated_by", "validated_at"]
LINK_SCHEMA = "`from` string, `to` string, relation string, note string, source string, validated_by string, validated_at string"


def parse_links(raw: DataFrame, json: str) -> DataFrame:
    """JSON link records to columns plus ``violation`` (null when the record is sound)."""
    rec = F.from_json(F.col(json), LINK_SCHEMA)
    extra = F.array_except(F.json_object_keys(F.col(json)), F.array(*[F.lit(f) for f in LINK_FIELDS]))
    missing = rec["from"].isNull() | rec["to"].isNull() | rec["relation"].isNull() | rec["note"].isNull()
    origin = F.coalesce(rec["source"], F.lit("curated"))
    violation = (F.when(rec.isNull() | missing, "missing_field").when(F.size(extra) > 0, "unknown_field")
                 .when(~rec["relation"].isin(RELATIONS), "relation").when(~origin.isin(ORIGINS), "source"))
    return raw.select(*[c for c in raw.columns if c != json], rec["from"].alias("from_chunk"), rec["to"].alias("to_chunk"), rec["relation"].alias("relation"),
                      rec["note"].alias("note"), origin.alias("source"), violation.alias("violation"))


def duplicate_links(links: DataFrame) -> DataFrame:
    """Exact (from, to, relation) triples that occur more than once."""
    return links.filter(F.col("violation").isNull()).groupBy("from_chunk", "to_chunk", "relation").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def load_links(raw: DataFrame, json: str) -> DataFrame:
    """Validated links; any violation or exact duplicate is an error."""
    links = parse_links(raw, json)
    bad = links.filter(F.col("violation").isNotNull()).limit(5).collect()
    if bad:
        raise ValueError(f"invalid links, for example: {[r.asDict() for r in bad]}")
    dup = duplicate_links(links).limit(5).collect()
    if dup:
        raise ValueError(f"duplicate links, for example: {[r.asDict() for r in dup]}")
    return links.drop("violation")


def payload_json(fields: list[str] | None = None) -> Column:
    return F.to_json(F.struct(*(fields or PAYLOAD)))
