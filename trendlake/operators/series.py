"""Time series: resampling, rolling figures, interpolation, calendars and verification.

Rolling operators take series of any length. Rows are numbered in order and
cut into stretches; rows near the end of a stretch are copied to the next one
as far as a window reaches, so that every window finds its rows in one place
and no task holds a whole series. Interpolation needs no copies: each stretch
is told the last value before it and the first one after it. ``hourly`` and
``daily_sum`` make series from raw rows with map-side sums.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trendlake.functions.dates import date_parts
from trendlake.operators.joins import number_rows
from trendlake.operators.quantiles import null_safe_join
from trendlake.session import materialise


#: Rows of a stretch, without the copies of its neighbours' rows.
STRETCH = 1 << 16
_AT, _STRETCH, _OWN = "_series_at", "_series_stretch", "_series_own"


def _numbered(df: DataFrame, order: str, by: Sequence[str]) -> DataFrame:
    """Rows numbered series by series in order; rows of one time in any order."""
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate([*by, order])], F.monotonically_increasing_id().alias("row"))
    return number_rows(df.withColumn("_series_key", key), "_series_key", _AT).drop("_series_key")


def _stretches(df: DataFrame, order: str, by: Sequence[str], before: int, after: int) -> DataFrame:
    """Every stretch with the ``before`` rows in front of it and the ``after`` rows behind it."""
    def stretch(at: Column) -> Column:
        return F.floor(F.greatest(at, F.lit(0)) / STRETCH)

    at = F.col(_AT)
    copies = _numbered(df, order, by).withColumn(_STRETCH, F.explode(F.sequence(stretch(at - after), stretch(at + before))))
    return copies.withColumn(_OWN, F.col(_STRETCH) == stretch(at))


def _centred(df: DataFrame, order: str, by: Sequence[str], window: int, column: Callable[[WindowSpec], Column], name: str) -> DataFrame:
    """``df`` with a figure of the ``window`` rows around each row."""
    before, after = window // 2, (window - 1) // 2
    rows = _stretches(df, order, by, before, after)
    w = Window.partitionBy(*by, _STRETCH).orderBy(_AT).rowsBetween(-before, after)
    # the figure is computed before the copies go
    return rows.withColumn(name, column(w)).filter(_OWN).drop(_AT, _STRETCH, _OWN)


def hour_start(ts: str) -> Column:
    """The hour a time falls in, in the type of the column and whatever the session time zone."""
    rest = F.make_dt_interval(mins=F.minute(ts), secs=F.extract(F.lit("SECOND"), F.col(ts)))
    return F.col(ts) - rest


def hourly(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), name: str = "y") -> DataFrame:
    """Sum per hour and series."""
    return df.groupBy(*by, hour_start(ts).alias("ts")).agg(F.sum(value).alias(name))


def hourly_counters(df: DataFrame, ts: str, kind: str, value: str, kinds: Mapping[str, str]) -> DataFrame:
    """One column per counter (``name -> kind``), null in hours it has no rows."""
    cols = [F.sum(F.when(F.col(kind) == k, F.col(value))).alias(n) for n, k in kinds.items()]
    return df.filter(F.col(kind).isin(list(kinds.values()))).groupBy(hour_start(ts).alias("ts")).agg(*cols)


def daily_sum(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), name: str = "y") -> DataFrame:
    """``ds, y``: sum per day from the first to the last day of a series; days without rows are 0."""
    sums = df.groupBy(*by, F.col(ts).cast("date").alias("ds")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(name))
    ends = sums.groupBy(*by).agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    days = F.explode(F.sequence("a", "b"))
    spine = ends.filter(F.col("a").isNotNull()).select(*by, days.alias("ds"))
    return spine.join(sums, [*by, "ds"], "left").select(*by, "ds", F.coalesce(name, F.lit(0.0)).alias(name))


def rolling_mean(
    df: DataFrame, order: str, value: str, window: int, min_periods: int | None = None,
    by: Sequence[str] = (), name: str = "rolling",
) -> DataFrame:
    """Centred mean over ``window`` rows; null with fewer than ``min_periods`` values (default: all)."""
    least = window if min_periods is None else min_periods
    return _centred(df, order, by, window, lambda w: F.when(F.count(value).over(w) >= least, F.avg(value).over(w)), name)


def rolling_corr(
    df: DataFrame, order: str, a: str, b: str, window: int = 90, min_periods: int | None = None,
    by: Sequence[str] = (), name: str = "rolling_r",
) -> DataFrame:
    """Centred Pearson correlation over ``window`` rows."""
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    least = window if min_periods is None else min_periods
    return _centred(df, order, by, window, lambda w: F.when(F.count(both).over(w) >= least, correlation(a, b, w)), name)


def median_filter(
    df: DataFrame, order: str, value: str, window: int = 24, k: float = 3.0, by: Sequence[str] = (),
    name: str | None = None,
) -> DataFrame:
    """Null out values further than k window deviations from the window median."""
    def near(w: WindowSpec) -> Column:
        away = F.abs(F.col(value) - F.percentile(value, F.lit(0.5)).over(w)) > k * F.stddev_samp(value).over(w)
        return F.when(~F.coalesce(away, F.lit(False)), F.col(value))

    # under a name of its own, as the figure must not replace what neighbours read
    found = _centred(df, order, by, window, near, "_series_near")
    out = found.withColumn(name or value, F.col("_series_near"))
    return out.drop("_series_near")


def interpolate(df: DataFrame, order: str, value: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Linear by position: leading gaps stay null, trailing gaps take the last value."""
    by = list(by)
    keys = [*by, _STRETCH]
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(_AT).alias("i"), F.col(value).cast("double").alias("v")))
    t = _numbered(df, order, by).withColumn(_STRETCH, F.floor(F.col(_AT) / STRETCH))
    t = materialise(t.withColumn("_known", known))
    # one row for each stretch of a series
    ends = t.groupBy(*keys).agg(F.min("_known").alias("_first"), F.max("_known").alias("_last"))
    line = Window.partitionBy(*by).orderBy(_STRETCH)
    carried = materialise(ends.select(
        *keys, F.last("_last", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    ))
    seq = Window.partitionBy(*keys).orderBy(_AT)
    t = null_safe_join(t, carried, keys)
    t = t.withColumn("_a", F.coalesce(F.last("_known", True).over(seq.rowsBetween(Window.unboundedPreceding, 0)), "_before"))
    t = t.withColumn("_b", F.coalesce(F.first("_known", True).over(seq.rowsBetween(0, Window.unboundedFollowing)), "_after"))
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.try_divide(F.col(_AT) - F.col("_a.i"), F.col("_b.i") - F.col("_a.i"))
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value).cast("double"))
        .when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), between)
        .otherwise(F.col("_a.v"))
    )
    return t.withColumn(name or value, filled).drop(_AT, _STRETCH, "_known", "_before", "_after", "_a", "_b")


def seasonal_cycle(df: DataFrame, ts: str, value: str, window: int = 720, min_periods: int = 20) -> DataFrame:
    """``dayofyear, mean, q25, q75`` of the rolling mean of an hourly series."""
    smooth = rolling_mean(df, ts, value, window, min_periods, name="_r")
    # A day of the year holds 24 values per calendar year of an hourly series.
    return smooth.groupBy(F.dayofyear(ts).alias("dayofyear")).agg(
        F.avg("_r").alias("mean"), F.percentile("_r", F.lit(0.25)).alias("q25"), F.percentile("_r", F.lit(0.75)).alias("q75")
    )


def weekday_hour_matrix(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Rows are weekdays (Monday 0), columns ``h0..h23`` hold the mean."""
    means = [F.avg(F.when(F.hour(ts) == h, F.col(value))).alias(f"h{h}") for h in range(24)]
    return df.groupBy(F.weekday(ts).alias("weekday")).agg(*means)


def weekend_by_hour(df: DataFrame, ts: str) -> DataFrame:
    """Adds ``is_weekend`` and ``hour``, the groups of the working-day comparison."""
    return df.withColumn("is_weekend", (F.weekday(ts) >= 5).cast("int")).withColumn("hour", F.hour(ts).cast("int"))


def with_date_parts(df: DataFrame, ts: str) -> DataFrame:
    return df.select("*", *date_parts(ts))


def event_calendar(events: DataFrame, suffix: str = " (Observed)") -> DataFrame:
    """``ds, holiday`` in date order; an observed day counts as the holiday itself."""
    name = F.regexp_replace("holiday", F.lit(f"\\Q{suffix}\\E$"), F.lit(""))
    return events.select(F.col("ds").cast("date").alias("ds"), name.alias("holiday")).distinct().orderBy("ds", "holiday")


def event_windows(calendar: DataFrame, lower: int = -2, upper: int = 2) -> DataFrame:
    """``ds, holiday, day``: one row per day of each event's window.

    Events with a ``lower_window`` or ``upper_window`` of their own in the calendar take that.
    """
    first, last = (
        F.coalesce(F.col(c).cast("int"), F.lit(d)) if c in calendar.columns else F.lit(d)
        for c, d in (("lower_window", lower), ("upper_window", upper))
    )
    days = F.when(first <= last, F.sequence(first, last))
    return calendar.withColumn("day", F.explode(days)).select(
        F.date_add(F.col("ds"), F.col("day")).alias("ds"), "holiday", "day"
    )


def split_by_year(df: DataFrame, ds: str, cut: int) -> tuple[DataFrame, DataFrame]:
    """Train: years before ``cut``. Test: ``cut`` and later. No row is in both."""
    return df.filter(F.year(ds) < cut), df.filter(F.year(ds) >= cut)


def with_split(df: DataFrame, ds: str, cut: int) -> DataFrame:
    return df.withColumn("split", F.when(F.year(ds) < cut, "train").otherwise("test"))


def regressor_series(df: DataFrame, ts: str, column: str, name: str, start: str, end: str) -> DataFrame:
    """One regressor prepared for a daily model: picked, renamed, sliced and interpolated."""
    day = F.col(ts).cast("date")
    sliced = df.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    daily = sliced.groupBy(day.alias("ds")).agg(F.avg(F.col(column)).alias(name))
    return interpolate(daily, "ds", name)


def attach_regressors(daily: DataFrame, regressors: Sequence[DataFrame]) -> DataFrame:
    """Left joins on ``ds``, for the observed days or for future ones."""
    for r in regressors:
        daily = daily.join(r, "ds", "left")
    return daily


def correlation(x: str, y: str, over: WindowSpec | None = None) -> Column:
    """Pearson r of the rows that have both; NaN where one of them never varies, null without a row."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    seen, shared, da, db = (
        f if over is None else f.over(over) for f in (F.count(a), F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b))
    )
    return F.when(seen > 0, F.coalesce(F.try_divide(shared, da * db), F.lit(float("nan"))))


def verification(forecast: DataFrame, observed: DataFrame, how: str = "inner", clip: bool = True) -> DataFrame:
    """Forecast next to the observation by day; negative forecasts become 0 if ``clip``."""
    joined = forecast.join(observed.select("ds", "y"), "ds", how)
    if not clip:
        return joined
    bounds = [c for c in ("yhat", "yhat_lower", "yhat_upper") if c in joined.columns]
    return joined.withColumns({c: F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) for c in bounds})


def accuracy(verif: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Pearson r, r2 (its square), mean absolute error and rows, per split or any other group."""
    r = correlation(yhat, y)
    return verif.groupBy(*by).agg(
        r.alias("r"), (r * r).alias("r2"), F.avg(F.abs(F.col(yhat) - F.col(y))).alias("mae"), F.count("*").alias("n")
    )


def residual_summary(verif: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Population skewness, median and mean of yhat - y (one row per day, so the median buffer is short)."""
    res = (F.col(yhat) - F.col(y)).alias("e")
    return verif.select(*by, res).groupBy(*by).agg(
        F.skewness("e").alias("skewness"), F.percentile("e", F.lit(0.5)).alias("median"), F.avg("e").alias("mean")
    )


def monthly_correlation(verif: DataFrame, by: Sequence[str] = (), ds: str = "ds", y: str = "y", yhat: str = "yhat") -> DataFrame:
    return verif.groupBy(*by, F.month(ds).alias("month")).agg(correlation(yhat, y).alias("r"), F.count("*").alias("n"))


def fit_line(verif: DataFrame, x: str = "yhat", y: str = "y") -> DataFrame:
    """The line through predicted and observed: slope, intercept, r and r2."""
    return verif.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        correlation(x, y).alias("r"), F.regr_r2(y, x).alias("r2"),
    )


