"""Joins that need a rule of their own; plain equi joins are left to ``DataFrame.join``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendlake.session import materialise
from trendlake.sources.files import hash_sample


def explode_items(df: DataFrame, items: str, item: str, keep_empty: bool = True) -> DataFrame:
    """One row per list item. ``keep_empty`` gives the left-join form (no item -> null) without a join."""
    gen = F.explode_outer if keep_empty else F.explode
    return df.select(*[c for c in df.columns if c != items], gen(items).alias(item))


def spread_by_key(df: DataFrame, keys: Sequence[str], rows: int = 1 << 19) -> DataFrame:
    """Rows of a key in one part, in parts of about ``rows`` rows.

    Groupings and joins by these keys need no other shuffle, and their tables
    in memory do not grow with the input, however few splits it comes in.
    """
    return df.repartition(1 + df.count() // rows, *keys)


def zero_fill(counts: DataFrame, spine: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every row of the spine, with 0 where ``counts`` has none."""
    return spine.join(counts, list(on), "left").na.fill(0, list(values))


def label_all(df: DataFrame, labels: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join of labels; rows that were never labelled keep null."""
    return df.join(labels.select(key, *columns), key, "left")


def relabel(df: DataFrame, mapping: DataFrame, column: str, new: str = "new_label") -> DataFrame:
    """Replace a label by its mapped value; unmapped labels become null."""
    joined = df.join(mapping.select(column, new), column, "left")
    return joined.select(*[F.col(new).alias(column) if c == column else F.col(c) for c in df.columns])


def dense_labels(df: DataFrame, column: str = "prediction", new: str = "new_label") -> DataFrame:
    """Distinct labels numbered 0..k-1 in order, however many there are."""
    return number_rows(df.select(column).distinct(), column, new).withColumn(new, F.col(new).cast("int"))


def number_rows(df: DataFrame, order: str, name: str = "number") -> DataFrame:
    """Consecutive numbers from 0 in the order of a unique column, for tables of any size.

    Rows are range-partitioned and numbered inside each partition; only the
    partition counts are summed up in one place.
    """
    placed = materialise(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    numbered = placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside - 1)
    return numbered.drop("_part", "_start")


def sampled_members(df: DataFrame, member: str, fraction: float, seed: int = 0) -> DataFrame:
    """All rows of a hash-chosen share of the members.

    The choice depends on the member alone, so it is a filter: the semi join
    with the set of chosen members would keep exactly the same rows.
    """
    return hash_sample(df.filter(F.col(member).isNotNull()), [member], fraction, seed)


def top_per_group(df: DataFrame, group: str, order: Sequence, n: int = 10) -> DataFrame:
    """First ``n`` rows of each group; Spark cuts each task's input to n per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
