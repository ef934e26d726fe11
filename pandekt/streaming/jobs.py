"""Structured Streaming versions of ingestion, retrieval, answer assembly and timing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pandekt.operators.live_index import LiveIndex
from pandekt.sources.index import upsert_index


def table_stream(spark: SparkSession, folder: str, glob: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the Parquet tables in ``folder`` whose name matches ``glob``; a table is one file or a folder of files."""
    # As a pattern: a stream takes the path of a single file only through one.
    path = f"{folder.rstrip('/')}/{{{glob}}}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(path)


PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which map state and timers need; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER_CONF)
    spark.conf.set(PROVIDER_CONF, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER_CONF, before)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is available into a Parquet table and stop. Run again with the same checkpoint it goes on where it stopped."""
    with rocksdb_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is available with a function per micro-batch and stop."""
    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


# --------------------------------------------------------------------- answers

ANSWER_SCHEMA = "request_id string, text string, n_deltas bigint, ttft_ms double, total_ms double, complete boolean"
#: Deltas of neighbouring numbers share an entry of the state: few calls, and no entry grows beyond this.
STATE_BLOCK = 64


class _Answer(StatefulProcessor):
    """Deltas of one request, kept by number in a map of blocks; a batch touches only the blocks of its own deltas."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("deltas", "block bigint", "seqs array<bigint>, texts array<string>, times array<double>")
        self.progress = handle.getValueState("progress", "n bigint, last bigint, latest double, timer bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        n, last, latest, timer = self.progress.get() if self.progress.exists() else (0, -1, float("-inf"), -1)
        fresh: dict[int, dict[int, tuple[str, float]]] = {}
        for pdf in rows:
            for seq, text, final, ms in zip(pdf["seq"].tolist(), pdf["text"].tolist(), pdf["is_final"].tolist(), pdf["ms"].tolist(), strict=True):
                fresh.setdefault(seq // STATE_BLOCK, {}).setdefault(seq, (text or "", ms, bool(final)))
        for block, found in fresh.items():
            seqs, texts, times = ([list(x) for x in self.blocks.getValue((block,))] if self.blocks.containsKey((block,)) else ([], [], []))
            known = set(seqs)
            new = {s: x for s, x in found.items() if s not in known}
            if not new:
                continue
            for seq, (text, ms, final) in new.items():
                seqs.append(seq)
                texts.append(text)
                times.append(ms)
                last = seq if final else last
            n, latest = n + len(new), max(latest, *(ms for _, ms, _ in new.values()))
            self.blocks.updateValue((block,), (seqs, texts, times))
        if last >= 0 and n == last + 1:
            yield self._row(key[0], True)
            self._forget(timer)
            return
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = max(int(latest) + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.progress.update((n, last, latest, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        if self.progress.exists():
            yield self._row(key[0], False)
            self._forget(-1)

    def _forget(self, timer: int) -> None:
        if timer >= 0:
            self.handle.deleteTimer(timer)
        self.blocks.clear()
        self.progress.clear()

    def _row(self, name: str, complete: bool) -> pd.DataFrame:
        deltas = sorted((s, t, ms) for seqs, texts, times in self.blocks.values() for s, t, ms in zip(seqs, texts, times, strict=True))
        times = [ms for _, _, ms in deltas]
        begin, end = min(times), max(times)
        first = next((ms for _, text, ms in deltas if text), end)
        return pd.DataFrame([{"request_id": name, "text": "".join(t for _, t, _ in deltas), "n_deltas": len(deltas),
                              "ttft_ms": first - begin, "total_ms": end - begin, "complete": complete}])

    def close(self) -> None:
        pass


def assemble_deltas(deltas: DataFrame, timeout_ms: int = 600_000, lateness: str = "10 minutes") -> DataFrame:
    """Stream of (request_id, seq, text, is_final, ts) to one row per finished answer.

    Deltas may arrive in any order and more than once; the first of a number
    counts. An answer is complete when its final delta and all earlier ones are
    there; an unfinished one is emitted as incomplete once the watermark is
    ``timeout_ms`` past its last delta. Event time is used for this: a
    processing-time timer would keep an available-now run alive for ever. The
    state is a map of deltas by number, so a batch costs what it brings. Start
    it through ``run_available``, which names the state store it needs.
    """
    rows = deltas.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).select(
        "request_id", F.col("seq").cast("long").alias("seq"), "text", "is_final", "ts", (F.unix_micros("ts") / 1000.0).alias("ms"))
    return rows.groupBy("request_id").transformWithStateInPandas(_Answer(timeout_ms), ANSWER_SCHEMA, "append", "EventTime")


def assemble_deltas_batch(deltas: DataFrame) -> DataFrame:
    """Batch twin of ``assemble_deltas``."""
    d = deltas.select("request_id", F.col("seq").cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), "is_final",
                      (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ms")).dropDuplicates(["request_id", "seq"])
    g = d.groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"),
        F.count(F.lit(1)).alias("n_deltas"), F.min("ms").alias("_b"), F.max("ms").alias("_e"),
        F.min_by(F.when(F.col("text") != "", F.col("ms")), F.when(F.col("text") != "", F.col("seq"))).alias("_f"),
        F.max(F.when(F.col("is_final"), F.col("seq"))).alias("_l"))
    return g.select("request_id", "text", "n_deltas", (F.coalesce("_f", "_e") - F.col("_b")).alias("ttft_ms"), (F.col("_e") - F.col("_b")).alias("total_ms"),
                    (F.coalesce(F.col("_l"), F.lit(-1)) + 1 == F.col("n_deltas")).alias("complete"))


# ------------------------------------------------------------- index, search


def stream_upsert(stream: DataFrame, index_path: str, checkpoint: str, order: list[str] | None = None) -> None:
    """Micro-batches into the index table; a repeated batch changes nothing.

    A newer version must arrive in the same or a later batch than an older one.
    """
    def handle(batch: DataFrame, _batch_id: int) -> None:
        upsert_index(batch.sparkSession, index_path, batch, "ensure", order=order)
    run_batches(stream, handle, checkpoint)


def stream_live_index(stream: DataFrame, index_path: str, checkpoint: str, order: list[str] | None = None) -> None:
    """Micro-batches of chunks into a searchable index; the index knows the last batch it took in from this checkpoint."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        LiveIndex(batch.sparkSession, index_path).upsert(batch, batch_id, order, source=checkpoint)
    run_batches(stream, handle, checkpoint)


def stream_retrieve(questions: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Arriving questions against a static index.

    ``search`` is a batch operator; every micro-batch overwrites its own
    partition, so a replayed batch leaves one copy.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    run_batches(questions, handle, checkpoint)


def windowed_timings(log: DataFrame, ts: str, step: str, value: str, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Count, mean and approximate median per step and tumbling window; late rows are dropped."""
    w = F.window(F.col("_ts"), width)
    return log.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness).groupBy(w.alias("w"), F.col(step)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile_approx(value, 0.5, 10000).alias("p50"),
    ).select(F.col("w.start").alias("window_start"), step, "n", "mean", "p50")
