"""Counts, shares and group profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendlake.functions.terms import percent
from trendlake.operators.clean import minmax_long, zscore
from trendlake.operators.joins import zero_fill
from trendlake.operators.quantiles import group_quantiles, null_safe_join
from trendlake.session import materialise


def item_counts(df: DataFrame, items: str, item: str = "item", n: int | None = None) -> DataFrame:
    """Occurrences of each list item, most frequent first."""
    out = (
        df.select(F.explode(items).alias(item)).groupBy(item).agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), item)
    )
    return out.limit(n) if n else out


def first_item_uniques(df: DataFrame, items: str, key: str, item: str = "item") -> DataFrame:
    """Distinct keys per first list item; pairs are de-duplicated before they are counted."""
    pairs = df.select(F.get(items, F.lit(0)).alias(item), key).filter(F.col(item).isNotNull()).distinct()
    return pairs.groupBy(item).agg(F.count("*").alias("unique_count")).orderBy(F.desc("unique_count"), item)


def keyword_shares(df: DataFrame, column: str, keywords: Sequence[str], empty: str = "[]") -> DataFrame:
    """``bucket, count, percentage``: empty lists, each keyword (substring, may overlap), and the rest."""
    hits = {k: F.col(column).contains(k) for k in keywords}
    none = ~(F.col(column) == empty)
    for h in hits.values():
        none = none & ~h
    wide = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(column) == empty).alias("empty"),
        *[F.count_if(h).alias(k) for k, h in hits.items()],
        F.count_if(none).alias("others"),
    )
    long = wide.unpivot(["total"], ["empty", *keywords, "others"], "bucket", "count")
    return long.select("bucket", "count", percent(F.col("count"), F.col("total")).alias("percentage"))


def cluster_sizes(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    return df.groupBy(prediction).agg(F.count("*").alias("n")).orderBy(prediction)


def drop_small_clusters(df: DataFrame, at_least: int, prediction: str = "prediction") -> DataFrame:
    """Rows of clusters with at least that many rows (semi join on the size table)."""
    big = materialise(df.groupBy(prediction).count().filter(F.col("count") >= at_least).select(prediction))
    return df.join(big, prediction, "left_semi")


def cluster_distribution(df: DataFrame, k: int, prediction: str = "prediction") -> DataFrame:
    """Rows per cluster for every label 0..k-1."""
    spine = df.sparkSession.range(k).select(F.col("id").cast("int").alias(prediction))
    return zero_fill(cluster_sizes(df, prediction), spine, [prediction], ["n"])


def cluster_share(df: DataFrame, period: str, prediction: str = "prediction") -> DataFrame:
    """``period, prediction, n, share``; the shares of a period sum to 1."""
    counts = df.groupBy(period, prediction).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(period))  # at most one row per cluster
    return counts.withColumn("share", F.col("n") / total)


def cluster_share_wide(df: DataFrame, period: str, k: int, prediction: str = "prediction") -> DataFrame:
    """One row per period with share columns ``cluster_0..cluster_{k-1}``, 0 where absent."""
    counts = [F.count_if(F.col(prediction) == i).alias(f"n{i}") for i in range(k)]
    wide = df.groupBy(period).agg(F.count("*").alias("n"), *counts)
    return wide.select(period, *[(F.col(f"n{i}") / F.col("n")).alias(f"cluster_{i}") for i in range(k)])


def cluster_profile(df: DataFrame, features: Sequence[str], prediction: str = "prediction") -> DataFrame:
    """Mean z-score (sample deviation) of every feature per cluster."""
    scaled = zscore(df.select(prediction, *features), features)
    return scaled.groupBy(prediction).agg(*[F.avg(c).alias(c) for c in features])


def group_trend_table(
    df: DataFrame, metrics: Sequence[str], year: str = "year", artist: str = "artist",
    name: str = "name", popularity: str = "popularity",
) -> DataFrame:
    """year x artist x metric: name of the most popular row, then mean, min, max, sd of the scaled metric.

    Equal popularity is settled by the smaller name.
    """
    long = minmax_long(df, [year, artist, name, popularity], metrics)
    best = F.min_by(name, F.struct(-F.col(popularity), F.col(name)))
    return long.groupBy(year, artist, "metric").agg(
        best.alias("name"),
        F.avg("value").alias("mean_val"), F.min("value").alias("min_val"),
        F.max("value").alias("max_val"), F.stddev_samp("value").alias("sd_val"),
    )


def box_plot(df: DataFrame, group: str, columns: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest values inside the fences) and outlier count per group and column."""
    keys = [group, "metric"]
    q = group_quantiles(df, [group], columns, [0.25, 0.5, 0.75])
    g = lambda i: F.get("q", F.lit(i))
    fences = materialise(q.select(
        *keys, "n", g(0).alias("q1"), g(1).alias("median"), g(2).alias("q3"),
        (g(0) - whisker * (g(2) - g(0))).alias("fence_low"),
        (g(2) + whisker * (g(2) - g(0))).alias("fence_high"),
    ))
    long = (
        df.select(group, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot([group], list(columns), "metric", "value").filter(F.col("value").isNotNull())
    )
    inside = F.col("value").between(F.col("fence_low"), F.col("fence_high"))
    carried = ["n", "q1", "median", "q3", "fence_low", "fence_high"]
    return (
        null_safe_join(long, fences, keys)
        .groupBy(*keys, *carried)
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
        .drop("fence_low", "fence_high")
    )


