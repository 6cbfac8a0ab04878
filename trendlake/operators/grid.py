"""Binning on a plane or a line: yearly grids, era map, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.functions.dates import dated
from trendlake.functions.vectors import with_coordinates
from trendlake.operators.clean import zscore
from trendlake.operators.quantiles import group_quantiles

EDGES = ("clamp", "digitize", "close")


def bin_index(value: Column, low: Column, high: Column, cells: int, edge: str = "clamp") -> Column:
    """Cell of a value on ``cells`` equal steps from low to high.

    clamp: values outside go to the end cells, the maximum to the last one.
    close: the last cell includes its upper end; values outside get null.
    digitize: number of edges not above the value, minus one, so the maximum
    gets index ``cells``, one past the last cell.
    A range of zero gives 0.
    """
    if edge not in EDGES:
        raise ValueError(f"edge must be one of {EDGES}")
    step = F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * cells)
    if edge == "clamp":
        step = F.greatest(F.least(step, F.lit(cells - 1)), F.lit(0))
    elif edge == "close":
        step = F.when(value.between(low, high), F.least(step, F.lit(cells - 1)))
    else:
        step = F.when(value >= high, F.lit(cells)).when(value < low, F.lit(-1)).otherwise(step)
    return F.when(high > low, step).otherwise(0).cast("int")


def _limits(rows: DataFrame, cols: Sequence[str]) -> Column:
    """One struct of min and max per column, as a scalar subquery."""
    figures = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.agg(F.struct(*figures).alias("s")).scalar()


def _binned(df, score, dims, cells, edge, year):
    rows = with_coordinates(
        df.filter(dated(year)), [F.col(year).cast("int").alias("year")], score, max(2, dims or 2)
    )
    lim = _limits(rows, ["x0", "x1"])
    axis = lambda c: bin_index(F.col(c), lim.getField(f"lo_{c}"), lim.getField(f"hi_{c}"), cells, edge)
    return rows.select("year", axis("x0").alias("x_bin"), axis("x1").alias("y_bin"))


def yearly_grid(
    df: DataFrame, score: str | Sequence[str], cells: int = 70, edge: str = "clamp",
    dims: int | None = None, year: str = "year",
) -> DataFrame:
    """``year, x_bin, y_bin, count`` over the first two dimensions; limits are those of all rows."""
    return _binned(df, score, dims, cells, edge, year).groupBy("year", "x_bin", "y_bin").agg(F.count("*").alias("count"))


def yearly_histogram_2d(df: DataFrame, score, edges: int = 50, dims: int | None = None, year: str = "year") -> DataFrame:
    """Histogram with ``edges`` edges per axis, that is ``edges - 1`` cells, the last one closed."""
    return yearly_grid(df, score, edges - 1, "close", dims, year)


def scale_grid(grid: DataFrame) -> DataFrame:
    """Counts scaled to 0..1 inside each year, 0 where a year's cells are all equal.

    The window sees cells, at most cells squared per year, not rows.
    """
    w = Window.partitionBy("year")
    lo, hi = F.min("count").over(w), F.max("count").over(w)
    scaled = F.when(hi > lo, (F.col("count") - lo) / (hi - lo)).otherwise(0.0)
    return grid.withColumn("normalized_count", scaled)


def dense_grid(grid: DataFrame, cells: int, value: str = "count") -> DataFrame:
    """Every cell of every present year, 0 where nothing was counted."""
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    spine = grid.select("year").distinct().select("year", axis().alias("x_bin")).select("year", "x_bin", axis().alias("y_bin"))
    return spine.join(grid.select("year", "x_bin", "y_bin", value), ["year", "x_bin", "y_bin"], "left").na.fill(0, [value])


def era_map(df: DataFrame, score, edges: int = 50, dims: int | None = None, year: str = "year") -> DataFrame:
    """Mean year per occupied cell; rows on an upper limit fall outside the cells."""
    cells = edges - 1
    b = _binned(df, score, dims, cells, "digitize", year)
    inside = F.col("x_bin").between(0, cells - 1) & F.col("y_bin").between(0, cells - 1)
    return b.filter(inside).groupBy("x_bin", "y_bin").agg(F.avg("year").alias("mean_year"), F.count("*").alias("count"))


def era_matrix(era: DataFrame, edges: int = 50) -> DataFrame:
    """All cells of the era map; cells without rows keep a null mean year."""
    axis = F.sequence(F.lit(0), F.lit(edges - 2))
    spine = era.sparkSession.range(1).select(F.explode(axis).alias("x_bin")).select("x_bin", F.explode(axis).alias("y_bin"))
    return spine.join(era.select("x_bin", "y_bin", "mean_year"), ["x_bin", "y_bin"], "left")


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 30, standardize: bool = True) -> DataFrame:
    """``metric, bin, bin_low, bin_high, count``: equal bins per column, the last one closed, empty ones 0."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if standardize:
        rows = zscore(rows, columns)
    lim = _limits(rows, columns)
    low = lambda c: lim.getField(f"lo_{c}")
    high = lambda c: lim.getField(f"hi_{c}")
    long = rows.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), bin_index(F.col(c), low(c), high(c), bins, "close").alias("bin"))
        for c in columns
    ]))).filter(F.col("bin").isNotNull())
    counts = long.groupBy("metric", "bin").agg(F.count("*").alias("count"))
    one = df.sparkSession.range(1)
    spine = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), low(c).alias("lo"), high(c).alias("hi")) for c in columns
    ]))).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return spine.join(counts, ["metric", "bin"], "left").select(
        "metric", "bin", (F.col("lo") + width * F.col("bin")).alias("bin_low"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def histogram_centres(df: DataFrame, columns: Sequence[str], standardize: bool = True) -> DataFrame:
    """``metric, mean, median`` that mark a histogram (of the z-scores if ``standardize``)."""
    spread = [F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")]
    both = group_quantiles(df, [], columns, [0.5], extra=spread).withColumn("median", F.get("q", F.lit(0)))
    if not standardize:
        return both.select("metric", "mean", "median")
    # Scaling keeps the order of values, so the median is scaled after it is found.
    return both.select(
        "metric", F.when(F.col("sd") > 0, F.lit(0.0)).alias("mean"),
        F.try_divide(F.col("median") - F.col("mean"), F.col("sd")).alias("median"),
    )
