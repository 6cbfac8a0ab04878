"""Casting, filtering, imputing and scaling. Global figures reach rows as scalar subqueries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.functions.dates import parse_date, year_of
from trendlake.functions.terms import percent
from trendlake.functions.vectors import coordinates
from trendlake.operators.quantiles import group_quantiles

# Column types of the track table, fixed by the data format. Loudness is
# fractional, so it is a double.
TRACK_INT = ["duration_ms", "key", "time_signature", "mode", "popularity"]
TRACK_BOOLEAN = ["explicit"]
TRACK_DOUBLE = [
    "loudness", "speechiness", "acousticness", "instrumentalness", "tempo",
    "danceability", "energy", "valence", "liveness",
]
TRACK_DATE = ["release_date"]
# The twelve audio features in their fixed order.
TRACK_FEATURES = [
    "duration_ms", "loudness", "key", "tempo", "time_signature", "mode", "acousticness",
    "instrumentalness", "speechiness", "danceability", "energy", "valence",
]


def cast_columns(
    df: DataFrame, ints: Sequence[str] = (), booleans: Sequence[str] = (),
    doubles: Sequence[str] = (), dates: Sequence[str] = (),
) -> DataFrame:
    """Typed copy of ``df``; text that does not fit its type becomes null. One projection."""
    kind = {**{c: "int" for c in ints}, **{c: "boolean" for c in booleans}, **{c: "double" for c in doubles}}

    def typed(c: str) -> Column:
        if c in dates:
            return parse_date(c).alias(c)
        return F.col(c).try_cast(kind[c]).alias(c) if c in kind else F.col(c)

    return df.select(*[typed(c) for c in df.columns])


def select_features(df: DataFrame, keys: Sequence[str], features: Sequence[str], name: str = "raw_features") -> DataFrame:
    """Keys plus one array of doubles; rows with a missing or unreadable feature are left out."""
    typed = [F.col(c).try_cast("double") for c in features]
    for value in typed:
        df = df.filter(value.isNotNull())
    return df.select(*keys, F.array(*typed).alias(name))


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def date_range(df: DataFrame, date: str, start: str, end: str, as_text: bool = False) -> DataFrame:
    """Rows from ``start`` to ``end``, both included.

    ``as_text`` compares strings, where a bare year sorts before its own first day.
    """
    if as_text:
        return df.filter(F.col(date).between(start, end))
    return df.filter(parse_date(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def year_range(df: DataFrame, date: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows by year of ``date``; either end may be open."""
    year = year_of(date)
    if first is not None:
        df = df.filter(year >= first)
    if last is not None:
        df = df.filter(year <= last)
    return df


def members(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def containing(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(F.col(column).contains(text))


def containing_share(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows with the text, all rows and the percentage, in one pass."""
    hit = F.count_if(F.col(column).contains(text))
    return df.agg(hit.alias("matching"), F.count("*").alias("total"), percent(hit, F.count("*")).alias("percentage"))


def equal_to(df: DataFrame, **values) -> DataFrame:
    for column, value in values.items():
        df = df.filter(F.col(column) == value)
    return df


def score_box(df: DataFrame, score: str | Sequence[str], low: float, high: float, dims: int | None = None) -> DataFrame:
    """Rows whose every score lies in [low, high]."""
    if isinstance(score, str):
        return df.filter((F.array_min(score) >= low) & (F.array_max(score) <= high))
    for x in coordinates(score, dims):
        df = df.filter(x.between(low, high))
    return df


def rename_drop(df: DataFrame, renames: Mapping[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(dict(renames or {}))


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing or unreadable values become the column mean."""
    typed = df.withColumns({c: F.col(c).try_cast("double") for c in columns})
    means = typed.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
    return typed.withColumns({c: F.coalesce(F.col(c), means.getField(c)) for c in columns})


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """``metric``, ``low``, ``high`` from exact quartiles of the given rows."""
    q = group_quantiles(df, [], columns, [0.25, 0.75])
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return q.select("metric", (q1 - k * (q3 - q1)).alias("low"), (q3 + k * (q3 - q1)).alias("high"))


def remove_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5, sequential: bool = True) -> DataFrame:
    """Rows inside the quartile fences of every column.

    Sequential: the fences of a column come from the rows the earlier columns
    left. Otherwise all fences come from the input, in one bounds pass.
    Only the two fence values per column come to the driver.
    """
    steps = [[c] for c in columns] if sequential else [list(columns)]
    for step in steps:
        for b in iqr_bounds(df, step, k).collect():
            df = df.filter(F.col(b["metric"]).between(b["low"], b["high"]))
    return df


def clip_lower(df: DataFrame, columns: Sequence[str], floor: float = 0.0) -> DataFrame:
    """Values below ``floor`` become ``floor``; missing values stay missing."""
    return df.withColumns({c: F.when(F.col(c) < floor, F.lit(floor)).otherwise(F.col(c)) for c in columns})


def add_counters(df: DataFrame, first: str, second: str, name: str = "total") -> DataFrame:
    """Sum of two counters, null when either is."""
    return df.withColumn(name, F.col(first) + F.col(second))


def period_slice(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows from ``start`` through the whole day ``end``."""
    after = F.date_add(F.lit(end).cast("date"), 1)
    return df.filter((F.col(ts) >= F.lit(start).cast("date")) & (F.col(ts) < after))


def zscore(df: DataFrame, columns: Sequence[str], suffix: str = "", ddof: int = 1) -> DataFrame:
    """(x - mean) / deviation; a constant column gives null."""
    dev = F.stddev_samp if ddof == 1 else F.stddev_pop
    s = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[dev(c).alias(f"s_{c}") for c in columns]).alias("s")).scalar()
    return df.withColumns({
        f"{c}{suffix}": F.try_divide(F.col(c) - s.getField(f"m_{c}"), s.getField(f"s_{c}")) for c in columns
    })


def minmax(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - min) / (max - min) over the whole table."""
    s = df.agg(F.struct(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).alias("s")).scalar()
    return df.withColumns({
        f"{c}{suffix}": F.try_divide(
            (F.col(c) - s.getField(f"lo_{c}")).cast("double"),
            (s.getField(f"hi_{c}") - s.getField(f"lo_{c}")).cast("double"),
        )
        for c in columns
    })


def minmax_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide to long, each metric scaled to 0..1 over its own rows.

    A group is a metric, that is every row of the table, so the bounds come
    from one wide aggregate rather than from a window holding all rows.
    """
    scaled = minmax(df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]), metrics)
    return scaled.unpivot(list(keys), list(metrics), "metric", "value")


def detail_listing(df: DataFrame, columns: Sequence[str], where: Column, order_by: str) -> DataFrame:
    """Chosen rows sorted by one feature, largest first."""
    return df.filter(where).orderBy(F.desc(order_by), *columns).select(*columns)


def artist_timeline(
    df: DataFrame, artists: Sequence[str], date: str, metrics: Sequence[str], artist: str = "artist",
    keep: Sequence[str] = (), scaled: bool = True,
) -> DataFrame:
    """The artists' rows in date order with their metrics, scaled over those rows if asked."""
    rows = df.filter(F.col(artist).isin(list(artists)))
    rows = rows.select(artist, *keep, date, *[F.col(m).cast("double").alias(m) for m in metrics])
    if scaled:
        rows = minmax(rows, metrics)
    return rows.orderBy(date, artist, *keep)


def extreme_scores(
    df: DataFrame, keep: Sequence[str], date: str, score: str, dim: int, above: float
) -> DataFrame:
    """Rows whose score in one dimension exceeds a threshold; unreadable dates are left out."""
    return (
        df.filter(F.get(F.col(score), F.lit(dim)) > above)
        .filter(parse_date(date).isNotNull())
        .select(
            *keep, year_of(date).alias("year"),
            F.get(F.col(score), F.lit(0)).cast("double").alias("pc1"),
            F.get(F.col(score), F.lit(1)).cast("double").alias("pc2"),
        )
    )
