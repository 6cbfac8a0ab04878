"""Profiling: each operator is one pass over the table unless it says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.functions.dates import parse_date
from trendlake.functions.terms import percent
from trendlake.operators.quantiles import group_quantiles


def examine(df: DataFrame, contains: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Row and column counts plus one spot-check count per ``name -> (column, text)``."""
    checks = [
        F.count_if(F.col(c).contains(text)).alias(name) for name, (c, text) in (contains or {}).items()
    ]
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), *checks)


def conditional_share(df: DataFrame, condition: Column) -> DataFrame:
    """Rows meeting a condition, all rows, and the percentage."""
    hit = F.count_if(condition)
    return df.agg(
        hit.alias("matching"), F.count("*").alias("total"), percent(hit, F.count("*")).alias("percentage")
    )


def placeholder_date_share(df: DataFrame, date: str, day: str = "01-01") -> DataFrame:
    """Share of dates on 1 January, the day partial dates are filled in with."""
    return conditional_share(df, F.date_format(parse_date(date), "MM-dd") == day)


def year_only_share(df: DataFrame, date: str) -> DataFrame:
    """Share of date texts that hold a year alone."""
    return conditional_share(df, F.length(date) == 4)


def value_frequency(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values; equal counts are ordered by value."""
    return df.groupBy(column).count().orderBy(F.desc("count"), column).limit(n)


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """One distinct count per column.

    Each column is de-duplicated on its own before counting, so no task holds a whole column.
    """
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(f"distinct_{c}") for c in columns])
    return df.agg(*[F.count_distinct(F.col(c)).alias(f"distinct_{c}") for c in columns])


def row_funnel(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Rows at the start, after dropping incomplete ones, and after the date range, in one pass."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])
    in_range = complete & parse_date(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return df.agg(
        F.count("*").alias("all_rows"),
        F.count_if(complete).alias("complete_rows"),
        F.count_if(in_range).alias("in_range_rows"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """``column_name``, ``nulls`` for every column."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column_name", "nulls")


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max per column, for all rows or per group.

    Groups and columns without any value have no row.
    """
    by = list(by)
    basics = [
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ]
    figures = group_quantiles(df, by, columns, [0.25, 0.5, 0.75], extra=basics)
    return figures.select(
        *by, "metric", F.col("n").alias("count"), "mean", "std", "min",
        F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(1)).alias("p50"),
        F.get("q", F.lit(2)).alias("p75"), "max",
    )


def preview(df: DataFrame, order: Sequence[str], n: int = 5, last: bool = False) -> DataFrame:
    """First or last ``n`` rows in an explicit order (a top-n, not a full sort)."""
    keys = [F.desc(c) if last else F.asc(c) for c in order]
    return df.orderBy(*keys).limit(n)


def distinct_values(df: DataFrame, column: str | Column, name: str | None = None) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    return df.select(c.alias(name) if name else c).distinct()
