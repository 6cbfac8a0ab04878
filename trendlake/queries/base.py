"""The query registry and the stand-in tables it reads."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlake.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its SQL text."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/trendlake/{name}-{uuid.uuid4().hex}"


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, with minus zero written as zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def bigint(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# lineitem as the track table: four features of like magnitude, an artist and a year.
TRACK_SQL = """tracks AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS artist, l_returnflag AS flag,
         l_shipdate AS release_date, l_partkey AS name,
         l_quantity / 10.0 AS q, l_extendedprice / 20000.0 AS p, l_discount * 50.0 AS d, l_tax * 50.0 AS t
  FROM lineitem)"""
FEATURES = ["q", "p", "d", "t"]


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("artist"),
        F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("release_date"),
        F.col("l_partkey").alias("name"),
        (F.col("l_quantity") / 10.0).alias("q"), (F.col("l_extendedprice") / 20000.0).alias("p"),
        (F.col("l_discount") * 50.0).alias("d"), (F.col("l_tax") * 50.0).alias("t"),
    )


# embeddings as the reduced space: key, score array, cluster and year.
SPACE_SQL = """space AS (
  SELECT vec_id, label AS prediction, CAST(1990 + vec_id % 20 AS INTEGER) AS year, embedding AS score,
         CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
  FROM embeddings)"""
DIMS = 64


def space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("prediction"),
        (F.lit(1990) + F.col("vec_id") % 20).cast("int").alias("year"), F.col("embedding").alias("score"),
    )


# part names as list literals: 'small ring' -> ['small', 'ring'].
LITERAL_SQL = """literals AS (
  SELECT p_partkey AS id, p_type, '[''' || replace(p_name, ' ', ''', ''') || ''']' AS genres FROM part)"""


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("['"), F.replace(F.col("p_name"), F.lit(" "), F.lit("', '")), F.lit("']"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type", quoted.alias("genres"))
