"""The four whole analyses, composed from the operators.

Each returns DataFrames; nothing but fitted models and fence values reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlake.functions.dates import year_of
from trendlake.functions.lists import parse_list_json
from trendlake.operators import basket, clean, forecast, series, trends
from trendlake.operators.cluster import Sweep, sweep
from trendlake.operators.features import Reduction, fit_pca, reduce_rows, scale
from trendlake.operators.joins import explode_items
from trendlake.operators.shares import drop_small_clusters
from trendlake.sources.files import TRACK_RAW, read_csv
from trendlake.session import materialise


def raw_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Raw track CSV -> typed table with one row per (id, artist).

    A track without a readable artist keeps one row with a null artist.
    """
    raw = read_csv(spark, path, TRACK_RAW).drop("id_artists")
    per_artist = explode_items(raw.withColumn("artists", parse_list_json("artists")), "artists", "artist")
    return clean.cast_columns(
        per_artist, clean.TRACK_INT, clean.TRACK_BOOLEAN, clean.TRACK_DOUBLE, clean.TRACK_DATE
    )


@dataclass
class Clustered:
    rows: DataFrame  # the input columns, raw_features, features (scores), year and prediction
    reduction: Reduction
    sweep: Sweep


def tracks_to_clusters(
    tracks: DataFrame, features: Sequence[str], date: str, start: str, end: str, threshold: float = 0.95,
    ks: Sequence[int] = range(2, 8), seed: int = 1, min_cluster: int = 10_000,
    first_year: int | None = None, last_year: int | None = None, partitions: int | None = None,
) -> Clustered:
    """Clean, scale, reduce and cluster with the keys kept, then drop small clusters and years out of range."""
    rows = clean.date_range(clean.drop_incomplete(tracks), date, start, end)
    scaled, _ = scale(rows.withColumn("raw_features", F.array(*[F.col(f).cast("double") for f in features])), features)
    fit = fit_pca(scaled, "scaled", len(features), threshold)
    # Read by every k-means pass: written once.
    scored = materialise(reduce_rows(scaled, fit, "scaled", "features").drop("scaled"))
    best = sweep(scored, "features", ks, seed, partitions=partitions)
    labelled = best.label(scored.withColumn("_scores", F.col("features"))).drop("features")
    labelled = labelled.withColumnRenamed("_scores", "features").withColumn("year", year_of(date))
    kept = clean.year_range(drop_small_clusters(labelled, min_cluster), date, first_year, last_year)
    return Clustered(kept, fit, best)


def yearly_measures(clustered: DataFrame, dims: int, score: str = "features", artist: str = "artist") -> DataFrame:
    """year -> dispersion, within- and between-artist dispersion, novelty and movement, side by side."""
    disp = trends.yearly_dispersion(clustered, score, dims)
    within = trends.within_artist_dispersion(clustered, score, dims, artist=artist)
    between = trends.between_artist_dispersion(clustered, score, dims, artist=artist)
    novelty = trends.yearly_innovation(clustered, score, dims)
    moves = trends.yearly_movement(clustered, score, dims).select("year", "cx", "cy", "step")
    return (
        disp.join(within.select("year", F.col("avg_distance").alias("within_artist")), "year", "left")
        .join(between.select("year", F.col("avg_distance").alias("between_artist")), "year", "left")
        .join(novelty, "year", "left").join(moves, "year", "left")
    )


@dataclass
class Rules:
    itemsets: DataFrame
    rules: DataFrame
    edges: DataFrame
    degrees: DataFrame


def lists_to_rules(
    df: DataFrame, column: str, min_support: float = 0.005, min_confidence: float = 0.4, top: int | None = None
) -> Rules:
    """List text -> item sets, rules, single-item rule edges and node degrees."""
    model = basket.mine(df.select(parse_list_json(column).alias("items")), "items", min_support, min_confidence)
    rules = basket.association_rules(model)
    edges = basket.rule_edges(rules, min_confidence, top)
    return Rules(basket.frequent_itemsets(model), rules, edges, basket.node_degrees(edges))


@dataclass
class Verified:
    daily: DataFrame
    model: forecast.Fitted
    verification: DataFrame
    accuracy: DataFrame
    residuals: DataFrame
    monthly: DataFrame


def counts_to_verified_forecast(
    counts: DataFrame, first: str, second: str, start: str, end: str, cut: int, design: forecast.Design,
    calendar: DataFrame | None = None, regressors: Sequence[DataFrame] = (), ts: str = "ts",
    filter_hours: int = 24, filter_k: float = 3.0,
) -> Verified:
    """Two hourly counters -> total, slice, outliers removed, daily sum, fit on early years, check on late ones."""
    total = clean.period_slice(clean.add_counters(counts, first, second, "y"), ts, start, end)
    smooth = series.median_filter(total, ts, "y", filter_hours, filter_k)
    daily = materialise(series.attach_regressors(series.daily_sum(smooth, ts, "y"), regressors))
    train, _ = series.split_by_year(daily, "ds", cut)
    model = forecast.fit(train, design, calendar)
    checked = series.with_split(series.verification(model.predict(daily), daily), "ds", cut)
    return Verified(
        daily, model, checked, series.accuracy(checked, ["split"]), series.residual_summary(checked, ["split"]),
        series.monthly_correlation(checked, ["split"]),
    )
