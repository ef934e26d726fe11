"""Streaming jobs run over the driver tables until the available data is used up."""

from pyspark.sql import functions as F

from pandekt.functions.ids import point_id
from pandekt.operators.answers import verify_citations
from pandekt.operators.fusion import stored
from pandekt.operators.live_index import LiveIndex
from pandekt.operators.search_index import build_index
from pandekt.operators.sparse import sparse_topk
from pandekt.plans.base import chunks, questions
from pandekt.plans.registry import query
from pandekt.plans.sqlbits import CHUNKS, QUESTIONS, bm25
from pandekt.session import cut_lineage, scratch_path
from pandekt.sources.index import read_index
from pandekt.streaming import jobs


def deltas(c):
    """Words of assistant turns as deltas: an empty first one, the words, an empty final one."""
    words = F.concat(F.array(F.lit("")), F.transform(F.split("text", " "), lambda w: F.concat(w, F.lit(" "))), F.array(F.lit("")))
    a = c.filter("role = 'assistant'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), words.alias("w"))
    return a.select("request_id", F.size("w").alias("n"), F.posexplode("w").alias("seq", "text")).select(
        "request_id", "seq", "text", (F.col("seq") == F.col("n") - 1).alias("is_final"), F.timestamp_millis(F.col("seq") * 40 + 1_700_000_000_000).alias("ts"))


DELTAS = """
d AS (SELECT conv_id || '-' || turn AS request_id, text || ' ' AS text, len(string_split(text, ' ')) + 2 AS n FROM conversations WHERE role = 'assistant')"""


@query("s1_assemble_deltas", f"WITH {DELTAS} SELECT request_id, text, n AS n_deltas, CAST(40 AS DOUBLE) AS ttft_ms, CAST((n - 1) * 40 AS DOUBLE) AS total_ms, TRUE AS complete FROM d")
def assemble(t):
    stream = jobs.table_stream(t.spark, t.sf_dir, "conversations.parquet")
    path = scratch_path(t.spark, "answers")
    jobs.run_available(jobs.assemble_deltas(deltas(stream)), path, scratch_path(t.spark, "ckpt"))
    return t.spark.read.parquet(path)


@query("s1_assemble_batch", f"WITH {DELTAS} SELECT request_id, text, n AS n_deltas, CAST(40 AS DOUBLE) AS ttft_ms, CAST((n - 1) * 40 AS DOUBLE) AS total_ms, TRUE AS complete FROM d")
def assemble_batch(t):
    return jobs.assemble_deltas_batch(deltas(t.conversations))


@query("s1_verified_stream", r"""WITH a AS (SELECT a.conv_id || '-' || a.turn AS request_id, regexp_replace(a.text, '(\p{L}+)\.', '[cite:\1].', 'g') AS text, coalesce(regexp_extract_all(u.text, '\p{L}+'), []) AS ctx
  FROM (SELECT * FROM conversations WHERE role = 'assistant') a LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1)
SELECT request_id, CAST(len(regexp_extract_all(text, '\[cite:([^\]\s]+)\]', 1)) AS BIGINT) AS n_total, CAST(len(list_filter(regexp_extract_all(text, '\[cite:([^\]\s]+)\]', 1), lambda x: list_contains(ctx, x))) AS BIGINT) AS n_verified FROM a""")
def verified(t):
    c = jobs.table_stream(t.spark, t.sf_dir, "conversations.parquet").withColumn("text", F.regexp_replace("text", r"(\p{L}+)\.", "[cite:$1]."))
    ctx = t.conversations.filter("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string")).alias("request_id"),
        F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("context"))
    checked = verify_citations(jobs.assemble_deltas(deltas(c)).join(ctx, "request_id", "left"), "text")
    path = scratch_path(t.spark, "verified")
    jobs.run_available(checked.select("request_id", "n_total", "n_verified"), path, scratch_path(t.spark, "ckpt"))
    return t.spark.read.parquet(path)


@query("s2_stream_upsert", f"WITH {CHUNKS} SELECT chunk_id, doc_urn, md5(text || ' [v2]') AS digest, CAST(2 AS INTEGER) AS version FROM chunks")
def upsert(t):
    d = jobs.table_stream(t.spark, t.sf_dir, "documents.parquet")
    rows = d.select(F.concat(F.col("source"), F.lit("__art_"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("doc_urn"),
                    F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), "text")
    rows = rows.select(point_id(F.col("chunk_id")).alias("point_id"), "chunk_id", "version", F.concat("text", F.lit(" [v"), F.col("version").cast("string"), F.lit("]")).alias("text"), "doc_urn")
    path = scratch_path(t.spark, "index")
    for _ in range(2):  # the same input delivered twice
        jobs.stream_upsert(rows, path, scratch_path(t.spark, "ckpt"), ["version"])
    return read_index(t.spark, path).select("chunk_id", F.col("doc_urn").cast("string").alias("doc_urn"), F.md5(F.col("text").cast("binary")).alias("digest"), "version")


@query("s3_stream_retrieve", f"WITH {CHUNKS},{QUESTIONS},{bm25('hits', 5)} SELECT * FROM hits")
def retrieve(t):
    c = chunks(t)
    index = build_index(c, scratch_path(t.spark, "search-index"))
    q = jobs.table_stream(t.spark, t.sf_dir, "benchmark.parquet").select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("qid"), "text")
    path = scratch_path(t.spark, "hits")
    jobs.stream_retrieve(q, lambda b: sparse_topk(b, c, 5, **stored(index)), path, scratch_path(t.spark, "ckpt"))
    return t.spark.read.parquet(path).select("qid", "rank", "chunk_id", "score")


@query("s2_live_index", f"""WITH c0 AS (SELECT source || '__art_' || doc_id AS chunk_id, source AS doc_urn, doc_id, text FROM documents),
chunks AS (SELECT chunk_id, doc_urn, CASE WHEN doc_id % 5 = 0 THEN text || ' ' || text || ' nuovo' ELSE text END AS text FROM c0 WHERE doc_id % 7 <> 3),
{QUESTIONS},{bm25('hits', 10)} SELECT * FROM hits""")
def live(t):
    """Documents in three batches: all of them, longer versions of some, removal of some; one batch comes twice."""
    c = chunks(t)
    index = LiveIndex(t.spark, scratch_path(t.spark, "live-index"))
    batches = [c, c.filter("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" "), "text", F.lit(" nuovo"))), c.filter("doc_id % 7 = 3").withColumn("text", F.lit(None).cast("string"))]
    for n in (0, 1, 1, 2):
        index = index.upsert(batches[n], n)
    return index.search(questions(t), 10)


@query("s4_windowed_timings", """
WITH w AS (SELECT date_trunc('hour', ts) AS window_start, event_type, value FROM events)
SELECT window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50 FROM w
GROUP BY window_start, event_type HAVING window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def timings(t):
    log = jobs.table_stream(t.spark, t.sf_dir, "events.parquet")
    path = scratch_path(t.spark, "timings")
    jobs.run_available(jobs.windowed_timings(log, "ts", "event_type", "value"), path, scratch_path(t.spark, "ckpt"))
    return t.spark.read.parquet(path).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean", 6).alias("mean"), "p50")
