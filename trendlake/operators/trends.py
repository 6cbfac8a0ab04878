"""Yearly centres, dispersion, movement and novelty of a score space.

Every table here starts from partial sums per (year[, artist]). Any number is
a year; rows with a null year belong to none (``dates.undated_rows`` counts
them). Year and artist tables are written out and Spark joins them by their
real size. Windows run over one row per year.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.functions.dates import dated
from trendlake.functions.terms import bin_labels
from trendlake.functions.vectors import coordinate_names, dimension, euclidean, with_coordinates
from trendlake.session import materialise

Score = str | Sequence[str]


def _rows(df: DataFrame, score: Score, dims: int | None, year: str, extra: Sequence[str] = ()) -> DataFrame:
    return with_coordinates(df.filter(dated(year)), [F.col(year).cast("int").alias("year"), *extra], score, dims)


def _centres(rows: DataFrame, by: Sequence[str], d: int, prefix: str = "c") -> DataFrame:
    return rows.groupBy(*by).agg(
        *[F.expr(f"avg(x{i}) AS {prefix}{i}") for i in range(d)], F.count("*").alias("n")
    )


def _with_year_distance(rows: DataFrame, d: int, extra: Sequence[str] = ()) -> DataFrame:
    """Rows with their distance to the centre of their year."""
    centre = materialise(_centres(rows, ["year"], d).drop("n"))
    return rows.join(centre, "year").select("year", *extra, euclidean(d).alias("distance"))


def _spread(std: str, ddof: int) -> Column:
    return F.stddev_samp(std) if ddof == 1 else F.stddev_pop(std)


def global_centre(df: DataFrame, score: Score, dims: int | None = None) -> DataFrame:
    """``dim, centre``: mean of every dimension over all rows."""
    names = coordinate_names(score, dims)
    wide = with_coordinates(df, [], score, dims).agg(*[F.avg(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(n).alias("centre")) for i, n in enumerate(names)])
    return wide.select(F.inline(pairs))


def yearly_centre(df: DataFrame, score: Score, dims: int | None = None, year: str = "year") -> DataFrame:
    """``year, cx, cy, n`` from the first two dimensions."""
    rows = _rows(df, score, max(2, dims or 2), year)
    return rows.groupBy("year").agg(F.avg("x0").alias("cx"), F.avg("x1").alias("cy"), F.count("*").alias("n"))


def yearly_movement(df: DataFrame, score: Score, dims: int | None = None, year: str = "year") -> DataFrame:
    """Centre, and its change since the previous year that has rows."""
    w = Window.orderBy("year")
    c = yearly_centre(df, score, dims, year)
    moved = c.withColumn("dx", F.col("cx") - F.lag("cx").over(w)).withColumn("dy", F.col("cy") - F.lag("cy").over(w))
    return moved.withColumn("step", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))


def yearly_dispersion(
    df: DataFrame, score: Score, dims: int | None = None, year: str = "year", ddof: int = 1
) -> DataFrame:
    """year -> mean, deviation and standard error of the distance to the year's centre, and rows."""
    d = dimension(score, dims)
    dist = _with_year_distance(_rows(df, score, dims, year), d)
    return _distance_summary(dist, ddof)


def _distance_summary(dist: DataFrame, ddof: int = 1) -> DataFrame:
    return dist.groupBy("year").agg(
        F.avg("distance").alias("avg_distance"),
        _spread("distance", ddof).alias("std_distance"),
        (_spread("distance", ddof) / F.sqrt(F.count("*"))).alias("se_distance"),
        F.count("*").alias("song_count"),
    )


def within_artist_dispersion(
    df: DataFrame, score: Score, dims: int | None = None, year: str = "year", artist: str = "artist",
    min_songs: int = 1, ddof: int = 1,
) -> DataFrame:
    """year -> distance of rows to their (artist, year) centre.

    ``min_songs=2`` leaves out artists with a single row that year, who would count as 0.
    """
    d = dimension(score, dims)
    rows = _rows(df, score, dims, year, [F.col(artist).alias("artist")])
    # Artists have no bound: written out, the table's real size decides the join,
    # and a crowded artist can be split because both sides are plain shuffles.
    centres = materialise(_centres(rows, ["year", "artist"], d).filter(F.col("n") >= min_songs).drop("n"))
    dist = rows.join(centres, ["year", "artist"]).select("year", euclidean(d).alias("distance"))
    return _distance_summary(dist, ddof)


def between_artist_dispersion(
    df: DataFrame, score: Score, dims: int | None = None, year: str = "year", artist: str = "artist", ddof: int = 1
) -> DataFrame:
    """year -> distance of artist centres to the mean of that year's artist centres."""
    d = dimension(score, dims)
    rows = _rows(df, score, dims, year, [F.col(artist).alias("artist")])
    artists = _centres(rows, ["year", "artist"], d, "x").drop("n")
    out = _distance_summary(_with_year_distance(artists, d), ddof)
    return out.withColumnRenamed("song_count", "artist_count")


def _tile_distances(d: int):
    xs = [f"x{i}" for i in range(d)]

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Sum of distances inside one block, or across one pair of blocks."""
        year, low, high = key
        a = pdf.loc[pdf["block"] == low, xs].to_numpy()
        b = a if low == high else pdf.loc[pdf["block"] == high, xs].to_numpy()
        total = 0.0
        for start in range(0, len(a), 256):
            diff = a[start:start + 256, None, :] - b[None, :, :]
            total += float(np.sqrt((diff * diff).sum(axis=2)).sum())
        if low == high:
            total, pairs = total / 2.0, len(a) * (len(a) - 1) // 2
        else:
            pairs = len(a) * len(b)
        return pd.DataFrame({"year": [year], "total": [total], "pairs": [pairs]})

    return tile


def between_artist_pairwise(
    df: DataFrame, score: Score, dims: int | None = None, year: str = "year", artist: str = "artist",
    block_rows: int = 2048,
) -> DataFrame:
    """year -> mean distance over all pairs of artist centres, exactly.

    The pairs are never written as rows. Each year's artists are hashed into
    blocks of about ``block_rows``; one task handles one pair of blocks and
    returns a single partial sum, so a year with very many artists becomes
    many tasks of bounded size.
    """
    d = dimension(score, dims)
    rows = _rows(df, score, dims, year, [F.col(artist).alias("artist")])
    artists = _centres(rows, ["year", "artist"], d, "x").drop("n")
    per_year = materialise(artists.groupBy("year").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks")))
    placed = artists.join(per_year, "year").withColumn(
        "block", F.pmod(F.xxhash64("artist"), F.col("blocks").cast("long")).cast("int")
    )
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "year", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        *[f"x{i}" for i in range(d)],
    )
    sums = tiles.groupBy("year", "low", "high").applyInPandas(_tile_distances(d), "year int, total double, pairs long")
    return sums.groupBy("year").agg(
        F.try_divide(F.sum("total"), F.sum("pairs")).alias("avg_distance"), F.sum("pairs").alias("pair_count")
    )


def artist_history_distance(
    df: DataFrame, score: Score, dims: int | None = None, year: str = "year", artist: str = "artist"
) -> DataFrame:
    """year -> mean distance of rows to the centre of the same artist's strictly earlier years."""
    d = dimension(score, dims)
    rows = _rows(df, score, dims, year, [F.col(artist).alias("artist")])
    sums = rows.groupBy("year", "artist").agg(*[F.expr(f"sum(x{i}) AS s{i}") for i in range(d)], F.count("*").alias("n"))
    before = Window.partitionBy("artist").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    past = materialise(sums.select(
        "year", "artist", *[(F.sum(f"s{i}").over(before) / F.sum("n").over(before)).alias(f"c{i}") for i in range(d)]
    ).filter(F.col("c0").isNotNull()))
    dist = rows.join(past, ["year", "artist"]).select("year", euclidean(d).alias("distance"))
    return dist.groupBy("year").agg(F.avg("distance").alias("avg_distance"), F.count("*").alias("song_count"))


def historical_centres(
    df: DataFrame, score: Score, dims: int | None = None, year: str = "year"
) -> DataFrame:
    """year, n, c* (centre of the year), h* (centre of all strictly earlier rows, null in the first year)."""
    d = dimension(score, dims)
    return _historical(_rows(df, score, dims, year), d)


def _historical(rows: DataFrame, d: int) -> DataFrame:
    sums = rows.groupBy("year").agg(*[F.expr(f"sum(x{i}) AS s{i}") for i in range(d)], F.count("*").alias("n"))
    before = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "year", "n",
        *[F.expr(f"s{i} / n AS c{i}") for i in range(d)],
        *[(F.sum(f"s{i}").over(before) / F.sum("n").over(before)).alias(f"h{i}") for i in range(d)],
    )


def yearly_innovation(df: DataFrame, score: Score, dims: int | None = None, year: str = "year") -> DataFrame:
    """within = mean distance to the year's centre; between = that centre to the centre of all earlier rows."""
    d = dimension(score, dims)
    rows = _rows(df, score, dims, year)
    c = materialise(_historical(rows, d))
    own = euclidean(d)
    between = euclidean(d, "c", "h")
    # The year's own figures are constant in a group: max reads them off.
    return rows.join(c, "year").groupBy("year").agg(F.avg(own).alias("within_year"), F.max(between).alias("between_year"))


def row_distances(
    df: DataFrame, score: Score, dims: int | None = None, year: str = "year", keep: Sequence[str] = ()
) -> DataFrame:
    """Every row with its distance to the current and to the historical centre."""
    d = dimension(score, dims)
    rows = _rows(df, score, dims, year, keep)
    c = materialise(_historical(rows, d))
    return rows.join(c, "year").select(
        "year", *keep,
        euclidean(d).alias("current_distance"),
        euclidean(d, "x", "h").alias("historical_distance"),
    )


def innovation_levels(
    df: DataFrame, score: Score, edges: Sequence[float], distance: str = "internal",
    dims: int | None = 2, year: str = "year", first_year: int | None = None, last_year: int | None = None,
) -> DataFrame:
    """Rows per year and distance bin ``[lo, hi)``, one column per bin; values outside all bins are not counted."""
    if distance not in ("internal", "historical"):
        raise ValueError("distance must be 'internal' or 'historical'")
    d = row_distances(df, score, dims, year)
    if first_year is not None:
        d = d.filter(F.col("year") >= first_year)
    if last_year is not None:
        d = d.filter(F.col("year") <= last_year)
    value = F.col("current_distance" if distance == "internal" else "historical_distance")
    return d.groupBy("year").agg(*[
        F.count_if((value >= lo) & (value < hi)).alias(label) for lo, hi, label in bin_labels(edges)
    ])


def levels_long(levels: DataFrame) -> DataFrame:
    """``year, bin, y`` from the wide bin table."""
    return levels.unpivot(["year"], [f"`{c}`" for c in levels.columns if c != "year"], "bin", "y")


def yearly_values(df: DataFrame, year: str, value: str, as_list: bool = False) -> DataFrame:
    """The distances of each year in long form; one array per year only when asked for."""
    rows = df.select(F.col(year).alias("year"), F.col(value).alias("value"))
    return rows.groupBy("year").agg(F.sort_array(F.collect_list("value")).alias("values")) if as_list else rows


def feature_trends(
    df: DataFrame, features: Sequence[str], window: int = 3, year: str = "year"
) -> DataFrame:
    """Per feature and year: mean scaled over the years to 0..1, its standard error, and both smoothed.

    Smoothing is a centred rolling mean over present years; an incomplete window gives null.
    """
    rows = df.filter(dated(year)).select(
        F.col(year).cast("int").alias("year"), *[F.col(f).cast("double").alias(f) for f in features]
    )
    wide = rows.groupBy("year").agg(*[
        F.struct(F.avg(f).alias("mean"), (F.stddev_samp(f) / F.sqrt(F.count(f))).alias("se")).alias(f)
        for f in features
    ])
    yearly = wide.unpivot(["year"], list(features), "feature", "v").select("year", "feature", "v.mean", "v.se")
    whole = Window.partitionBy("feature")
    span = F.max("mean").over(whole) - F.min("mean").over(whole)
    scaled = yearly.select(
        "year", "feature", "mean",
        F.try_divide(F.col("mean") - F.min("mean").over(whole), span).alias("scaled_mean"),
        F.try_divide(F.col("se"), span).alias("scaled_se"),
    )
    frame = Window.partitionBy("feature").orderBy("year").rowsBetween(-(window // 2), (window - 1) // 2)
    smooth = lambda c: F.when(F.count(c).over(frame) == window, F.avg(c).over(frame))
    return scaled.withColumn("trend", smooth("scaled_mean")).withColumn("trend_se", smooth("scaled_se"))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept and r2 of the least-squares line."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )
