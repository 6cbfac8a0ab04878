"""Gaussian density curves per year or per window of years."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.functions.dates import dated, window_start
from trendlake.functions.vectors import coordinate_names, with_coordinates
from trendlake.session import materialise


def density_curves(
    df: DataFrame, score: str | Sequence[str], dims: int | None = 2, year: str = "year",
    width: int = 1, points: int = 200, prebin: int | None = None,
) -> DataFrame:
    """``period, dim, point, x, density`` at ``points`` places over each dimension's global range.

    Bandwidth is sample deviation * n^(-1/5). Periods with fewer than two rows
    or no spread have no curve. Every row adds its kernel to each place, and
    those sums combine inside each task, so only periods x dims x points
    partial sums are shuffled. ``prebin`` first replaces rows by the means of
    that many equal cells: cheaper, and then an approximation.
    """
    names = coordinate_names(score, dims)
    period = F.col(year).cast("int") if width == 1 else window_start(year, width)
    rows = with_coordinates(df.filter(dated(year)), [period.alias("period")], score, dims)
    # Periods are years and dims are few, so this table is bounded.
    per_dim = [
        F.struct(F.lit(i).alias("dim"), F.count("*").alias("n"), F.stddev_samp(n).alias("sd"),
                 F.min(n).alias("lo"), F.max(n).alias("hi"))
        for i, n in enumerate(names)
    ]
    stats = rows.groupBy("period").agg(F.array(*per_dim).alias("s")).select("period", F.inline("s"))
    span = rows.agg(F.array(*[
        F.struct(F.min(n).alias("lo"), F.max(n).alias("hi")) for n in names
    ]).alias("s")).scalar()
    here = F.get(span, F.col("dim"))
    bands = stats.filter((F.col("n") >= 2) & (F.col("sd") > 0)).select(
        "period", "dim", "n", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
        here.getField("lo").alias("lo"), here.getField("hi").alias("hi"),
    )
    long = rows.select("period", F.inline(F.array(*[
        F.struct(F.lit(i).alias("dim"), F.col(n).alias("v")) for i, n in enumerate(names)
    ])))
    weighted = long.join(materialise(bands), ["period", "dim"]).withColumn("w", F.lit(1.0))
    if prebin:
        cell = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * prebin)
        weighted = weighted.groupBy("period", "dim", "n", "h", "lo", "hi", cell.alias("cell")).agg(
            F.avg("v").alias("v"), F.sum("w").alias("w")
        )
    at = weighted.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    place = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / F.lit(float(points - 1))
    z = (place - F.col("v")) / F.col("h")
    kernel = F.exp(F.lit(-0.5) * z * z)
    return at.groupBy("period", "dim", "point", "n", "h", "lo", "hi").agg(F.sum(F.col("w") * kernel).alias("k")).select(
        "period", "dim", "point", place.alias("x"),
        (F.col("k") / (F.col("n") * F.col("h") * math.sqrt(2.0 * math.pi))).alias("density"),
    )


def density_peaks(curves: DataFrame) -> DataFrame:
    """Highest density of any period, per dimension."""
    return curves.groupBy("dim").agg(F.max("density").alias("max_density"))
