"""Session defaults for local runs and the shared-folder helpers that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "trendlake") -> SparkSession:
    """A single-JVM session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset, a single-machine session gets a temporary folder; on
    several machines no such folder is shared, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="trendlake-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def clear_written(spark: SparkSession) -> None:
    """Removes all tables that were written to the shared folder; call it when no result of them is in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/trendlake")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in ``parts`` files at most if given, and read it back.

    Cuts lineage in a way that survives a lost executor, and gives the next
    plan real file sizes, so Spark broadcasts the table only if it is small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trendlake/{uuid.uuid4().hex}"
    if parts:
        df = df.coalesce(parts)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``materialise`` wrote and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def side_by_side(spark: SparkSession, work: Callable, items: Iterable, parallelism: int = 4) -> list:
    """``work`` for every item, a few at a time, in order: independent fits share the cluster."""
    items = list(items)
    if len(items) < 2 or parallelism < 2:
        return [work(i) for i in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)
