"""Shared pieces of the operators: written tables, white space, row folds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.session import shared_folder

WHITE = " \t\n\x0b\x0c\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def parts_for(table: DataFrame) -> int:
    """How many files are enough for tables made from a written one: one for 2 MB of it, one a core at least."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(table.sparkSession.sparkContext.defaultParallelism, min(-(-size // 2**21), 2**20))


def written(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back, in ``parts`` files at most if given.

    The shuffle files behind the write are of no further use, so they are
    removed as soon as it ends instead of when the driver collects garbage.
    """
    spark = df.sparkSession
    if parts:
        df = df.coalesce(parts)
    path = f"{shared_folder(spark)}/trendlake/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(key: str | Column, folds: int) -> Column:
    """The fold of a row: crc32 of its key as text, modulo ``folds`` (null keys: that of empty text)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def unused(name: str, columns: list[str]) -> str:
    """``name``, or the first of it with more underscores in front that is no column (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def empty_if_null(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))
