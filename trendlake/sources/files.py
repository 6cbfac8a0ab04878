"""Readers and writers: declared schemas in, whole tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.functions.dates import year_of

# Column names of the track inputs, fixed by the data format.
TRACK_RAW_COLUMNS = [
    "id", "name", "popularity", "duration_ms", "explicit", "artists", "id_artists",
    "release_date", "danceability", "energy", "key", "loudness", "mode", "speechiness",
    "acousticness", "instrumentalness", "liveness", "valence", "tempo", "time_signature",
]


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


TRACK_RAW = text_schema(TRACK_RAW_COLUMNS)


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """CSV with a header and a declared schema (names alone mean text); no inference pass."""
    if not isinstance(schema, T.StructType):
        schema = text_schema(schema)
    df = spark.read.schema(schema).csv(
        path, header=True, enforceSchema=False, quote='"', escape='"'
    )
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table; ``columns`` reach the scan as its read schema."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_timed_csv(
    spark: SparkSession, path: str | list[str], value_columns: Sequence[str],
    ts: str = "ts", fmt: str | None = None,
) -> DataFrame:
    """CSV files whose first column is a time; a glob reads all years as one frame.

    Row order across files is not kept by a scan: sort by ``ts`` where order matters.
    """
    raw = read_csv(spark, path, [ts, *value_columns])
    parsed = F.try_to_timestamp(F.col(ts), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(ts))
    return raw.select(
        parsed.alias(ts), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in value_columns]
    )


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header, overwriting. One file means one writing task, so it is opt-in."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def labelled_ids(df: DataFrame, cluster: int, label: str, key: str = "id", prediction: str = "prediction") -> DataFrame:
    """Keys of one cluster with a constant label, ready to be written as an exclusion list."""
    return df.filter(F.col(prediction) == cluster).select(key, F.lit(label).alias("label"))


def exclude_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not in ``ids``; the list may be any size, so Spark picks the join."""
    return df.join(ids.select(key), key, "left_anti")


def chart_extract(
    df: DataFrame, date: str, fraction: float | None = None, seed: int | None = None,
    artist: str | None = None, artist_col: str = "artist", keys: Sequence[str] = (),
) -> DataFrame:
    """One artist's rows, or a share of all rows chosen by the hash of their ``keys`` (all columns, if none is named), with the year added."""
    if artist is not None:
        df = df.filter(F.col(artist_col) == artist)
    elif fraction is not None:
        df = hash_sample(df, keys or df.columns, fraction, seed or 0)
    return df.withColumn("year", year_of(date))


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 0) -> DataFrame:
    """Share of keys chosen by their hash: the same rows whatever the file layout."""
    return df.filter(_unit_hash(keys, seed) < F.lit(fraction))


def hash_split(df: DataFrame, keys: Sequence[str], fraction: float = 0.5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that together hold every row."""
    u = _unit_hash(keys, seed)
    return df.filter(u < F.lit(fraction)), df.filter(u >= F.lit(fraction))


def _unit_hash(keys: Sequence[str], seed: int):
    h = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    return F.pmod(h, F.lit(1_000_000)) / F.lit(1_000_000.0)
