"""Session helpers: local defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
UNION_CONF = "spark.sql.unionOutputPartitioning"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on.

    Spark 4.1 lets a union keep the partitioning of its inputs. Together with
    exchange reuse under adaptive execution this mixes up partitions when such
    a union occurs on both sides of a join (for example fused hits joined with
    themselves), and rows are lost. The option is turned off; the cost is one
    exchange of already aggregated rows.
    """
    spark.conf.set(UNION_CONF, "false")
    return spark


def local_session(app: str = "pandekt", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and single-machine runs. Clusters bring their own."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PANDEKT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master
    without the setting falls back to a fresh temporary folder.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    return _local_dir()


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-pandekt-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder; see ``clear_scratch``."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


_scratch: list[str] = []


def clear_scratch(spark: SparkSession) -> int:
    """Delete what ``scratch_path`` handed out in this process; returns the number of folders.

    Call it when no DataFrame built on those folders is needed any more.
    """
    conf, gone = spark._jsc.hadoopConfiguration(), 0
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy survives lost executors, and row-to-partition assignments made
    before the cut cannot change when a task is run again.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for an input that arrives in too few partitions.

    A table of many files keeps its scan partitions and no shuffle is added;
    only a scan with fewer partitions than cores is redistributed by ``key``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
