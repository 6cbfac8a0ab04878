"""Local regression over yearly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _local_fit(series: Column, x0: Column, span: float) -> Column:
    """Local quadratic at ``x0`` with tricube weights over the nearest share of the points."""
    nearest = F.greatest(F.floor(F.lit(span) * F.size(series) + F.lit(1e-5)), F.lit(1)).cast("int")
    distances = F.array_sort(F.transform(series, lambda p: F.abs(p.x - x0)))
    reach = F.get(distances, nearest - 1)

    def weighted(p: Column) -> Column:
        u = p.x - x0
        ratio = F.abs(u) / F.nullif(reach, F.lit(0.0))
        cube = F.lit(1.0) - ratio * ratio * ratio
        w = F.when(F.abs(u) < reach, cube * cube * cube).otherwise(F.when(u == 0.0, 1.0).otherwise(0.0))
        return F.struct(w.alias("w"), u.alias("u"), p.y.alias("y"))

    names = ["s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"]

    def add(acc: Column, p: Column) -> Column:
        u, w, y = p.u, p.w, p.y
        moments = [w, w * u, w * u * u, w * u * u * u, w * u * u * u * u, w * y, w * u * y, w * u * u * y]
        return F.struct(*[(acc[n] + m).alias(n) for n, m in zip(names, moments)])

    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])
    return F.aggregate(F.transform(series, weighted), zero, add)


def _fitted(m: Column) -> Column:
    """Value at the centre from the moment sums: quadratic, else line, else weighted mean."""
    s0, s1, s2, s3, s4 = (m[f"s{i}"] for i in range(5))
    t0, t1, t2 = (m[f"t{i}"] for i in range(3))
    det3 = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    num3 = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    det2 = s0 * s2 - s1 * s1
    num2 = t0 * s2 - s1 * t1
    tiny = 1e-9
    return (
        F.when(det3 > s0 * s2 * s4 * tiny, F.try_divide(num3, det3))
        .when(det2 > s0 * s2 * tiny, F.try_divide(num2, det2))
        .otherwise(F.try_divide(t0, s0))
    )


def loess(
    series: DataFrame, by: Sequence[str], x: str = "year", y: str = "mean_val", span: float = 0.75
) -> DataFrame:
    """Smoothed ``y`` at every ``x`` of every group.

    ``series`` has one row per group and x (a year table, so a group is at most
    a few thousand points); repeated x are averaged first, and a group then
    travels as one short array instead of being joined with itself.
    """
    once = series.groupBy(*by, x).agg(F.avg(y).alias("y")).filter(F.col("y").isNotNull())
    point = F.struct(F.col(x).cast("double").alias("x"), F.col("y"))
    grouped = once.groupBy(*by).agg(F.array_sort(F.collect_list(point)).alias("series"))
    rows = grouped.select(*by, "series", F.explode("series").alias("p"))
    fits = rows.select(*by, F.col("p.x").alias("x"), F.col("p.y").alias("y"), _local_fit(F.col("series"), F.col("p.x"), span).alias("m"))
    return fits.select(*by, F.col("x").cast("int").alias(x), "y", _fitted(F.col("m")).alias("smooth"))
