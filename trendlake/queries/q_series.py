"""Time series queries over the event stream and the daily order totals."""

from pyspark.sql import functions as F

from trendlake.operators import profile as P
from trendlake.operators import series as S
from trendlake.operators.clean import add_counters
from trendlake.operators.grid import histograms
from trendlake.queries.base import query, r, rounded, table

_HOURLY = """hourly AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS y FROM events GROUP BY 1)"""


def hourly(spark, d):
    return S.hourly(table(spark, d, "events"), "ts", "value")


def _ts(df, c="ts"):
    return df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


@query("sum_of_two_counters", f"""
WITH h AS (SELECT date_trunc('hour', ts) AS ts, sum(value) FILTER (WHERE event_type = 'click') AS wb,
                  sum(value) FILTER (WHERE event_type = 'view') AS eb FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT {TS}, round(wb, 4) AS wb, round(eb, 4) AS eb, round(wb + eb, 4) AS total FROM h""")
def sum_of_two_counters(spark, d):
    h = S.hourly_counters(table(spark, d, "events"), "ts", "event_type", "value", {"wb": "click", "eb": "view"})
    return rounded(_ts(add_counters(h, "wb", "eb")), ["wb", "eb", "total"], 4)


@query("daily_resample", """
WITH s AS (SELECT CAST(ts AS DATE) AS ds, sum(value) AS y FROM events GROUP BY 1)
SELECT strftime(g, '%Y-%m-%d') AS ds, round(coalesce(y, 0.0), 4) AS y
FROM generate_series((SELECT min(ds) FROM s), (SELECT max(ds) FROM s), INTERVAL 1 DAY) t(g) LEFT JOIN s ON s.ds = CAST(g AS DATE)""")
def daily_resample(spark, d):
    out = S.daily_sum(table(spark, d, "events"), "ts", "value")
    return out.select(F.col("ds").cast("string").alias("ds"), r("y", 4).alias("y"))


@query("daily_resample_by_user", """
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS ds, sum(value) AS y FROM events GROUP BY 1, 2),
e AS (SELECT user_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS g FROM s GROUP BY user_id)
SELECT e.user_id, strftime(g, '%Y-%m-%d') AS ds, round(coalesce(y, 0.0), 4) AS y FROM e LEFT JOIN s ON s.user_id = e.user_id AND s.ds = CAST(g AS DATE)""")
def daily_resample_by_user(spark, d):
    out = S.daily_sum(table(spark, d, "events"), "ts", "value", ["user_id"])
    return out.select("user_id", F.col("ds").cast("string").alias("ds"), r("y", 4).alias("y"))


@query("rolling_mean_hours", f"""
WITH {_HOURLY} SELECT {TS}, round(CASE WHEN count(y) OVER w >= 20 THEN avg(y) OVER w END, 6) AS rolling FROM hourly
WINDOW w AS (ORDER BY hourly.ts ROWS BETWEEN 360 PRECEDING AND 359 FOLLOWING)""")
def rolling_mean_hours(spark, d):
    return _ts(S.rolling_mean(hourly(spark, d), "ts", "y", 720, 20)).select("ts", r("rolling").alias("rolling"))


@query("rolling_mean_full_window", f"""
WITH {_HOURLY} SELECT {TS}, round(CASE WHEN count(y) OVER w >= 30 THEN avg(y) OVER w END, 6) AS rolling FROM hourly
WINDOW w AS (ORDER BY hourly.ts ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)""")
def rolling_mean_full_window(spark, d):
    return _ts(S.rolling_mean(hourly(spark, d), "ts", "y", 30)).select("ts", r("rolling").alias("rolling"))


@query("median_filter", f"""
WITH {_HOURLY} SELECT {TS}, round(CASE WHEN abs(y - quantile_cont(y, 0.5) OVER w) > 2 * stddev_samp(y) OVER w THEN NULL ELSE y END, 4) AS y
FROM hourly WINDOW w AS (ORDER BY hourly.ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)""")
def median_filter(spark, d):
    return _ts(S.median_filter(hourly(spark, d), "ts", "y", 24, 2.0)).select("ts", r("y", 4).alias("y"))


@query("rolling_correlation", """
WITH h AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS y, CAST(count(*) AS DOUBLE) AS yhat FROM events GROUP BY 1)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(CASE WHEN count(*) OVER w >= 90 THEN corr(yhat, y) OVER w END, 6) AS rolling_r FROM h
WINDOW w AS (ORDER BY h.ts ROWS BETWEEN 45 PRECEDING AND 44 FOLLOWING)""")
def rolling_correlation(spark, d):
    h = table(spark, d, "events").groupBy(S.hour_start("ts").alias("ts")).agg(F.sum("value").alias("y"), F.count("*").cast("double").alias("yhat"))
    return _ts(S.rolling_corr(h, "ts", "yhat", "y", 90)).select("ts", r("rolling_r").alias("rolling_r"))


@query("linear_interpolation", """
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS ds, sum(value) AS v FROM events GROUP BY 1, 2),
e AS (SELECT user_id, unnest(generate_series(min(ds) - 1, max(ds) + 1, INTERVAL 1 DAY)) AS g FROM s GROUP BY user_id),
t AS (SELECT e.user_id, g AS ds, v, row_number() OVER (PARTITION BY e.user_id ORDER BY g) AS rn
      FROM e LEFT JOIN s ON s.user_id = e.user_id AND s.ds = CAST(g AS DATE)),
k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN rn END) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS ra,
             min(CASE WHEN v IS NOT NULL THEN rn END) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rb FROM t)
SELECT k.user_id, strftime(k.ds, '%Y-%m-%d') AS ds, round(CASE WHEN k.v IS NOT NULL THEN k.v WHEN ra IS NULL THEN NULL WHEN rb IS NULL THEN a.v
       ELSE a.v + (b.v - a.v) * (k.rn - ra) / (rb - ra) END, 4) AS v
FROM k LEFT JOIN t a ON a.user_id = k.user_id AND a.rn = ra LEFT JOIN t b ON b.user_id = k.user_id AND b.rn = rb""")
def linear_interpolation(spark, d):
    sums = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("ds")).agg(F.sum("value").alias("v"))
    ends = sums.groupBy("user_id").agg(F.date_sub(F.min("ds"), 1).alias("a"), F.date_add(F.max("ds"), 1).alias("b"))
    gaps = ends.select("user_id", F.explode(F.sequence("a", "b")).alias("ds")).join(sums, ["user_id", "ds"], "left")
    out = S.interpolate(gaps, "ds", "v", ["user_id"])
    return out.select("user_id", F.col("ds").cast("string").alias("ds"), r("v", 4).alias("v"))


@query("seasonal_cycle", f"""
WITH {_HOURLY}, s AS (SELECT ts, CASE WHEN count(y) OVER w >= 20 THEN avg(y) OVER w END AS m FROM hourly
  WINDOW w AS (ORDER BY hourly.ts ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING))
SELECT CAST(dayofyear(ts) AS INTEGER) AS dayofyear, round(avg(m), 4) AS mean, round(quantile_cont(m, 0.25), 4) AS q25,
       round(quantile_cont(m, 0.75), 4) AS q75 FROM s GROUP BY 1""")
def seasonal_cycle(spark, d):
    return rounded(S.seasonal_cycle(hourly(spark, d), "ts", "y", 48, 20), ["mean", "q25", "q75"], 4)


@query("weekday_hour_matrix", f"""
WITH {_HOURLY} SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  {', '.join(f"round(avg(y) FILTER (WHERE hour(ts) = {h}), 6) AS h{h}" for h in range(24))} FROM hourly GROUP BY 1""")
def weekday_hour_matrix(spark, d):
    return rounded(S.weekday_hour_matrix(hourly(spark, d), "ts", "y"), [f"h{h}" for h in range(24)])


@query("weekend_by_hour", f"""
WITH {_HOURLY} SELECT CAST(isodow(ts) > 5 AS INTEGER) AS is_weekend, CAST(hour(ts) AS INTEGER) AS hour, 'y' AS metric, count(y) AS count,
  round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std, round(min(y), 6) AS min, round(quantile_cont(y, 0.25), 6) AS p25,
  round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.75), 6) AS p75, round(max(y), 6) AS max FROM hourly GROUP BY 1, 2""")
def weekend_by_hour(spark, d):
    out = P.describe(S.weekend_by_hour(hourly(spark, d), "ts"), ["y"], ["is_weekend", "hour"])
    return rounded(out, ["mean", "std", "min", "p25", "p50", "p75", "max"])


@query("event_calendar", """
SELECT DISTINCT strftime(make_date(CAST(year(o_orderdate) AS INTEGER), 1, 1), '%Y-%m-%d') AS ds, 'New Year' AS holiday FROM orders""")
def event_calendar(spark, d):
    return S.event_calendar(_new_years(spark, d)).withColumn("ds", F.col("ds").cast("string"))


def _new_years(spark, d):
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    name = F.when(F.col("y") % 2 == 0, "New Year (Observed)").otherwise("New Year")
    return years.select(F.make_date("y", F.lit(1), F.lit(1)).alias("ds"), name.alias("holiday"))


@query("event_windows", """
WITH c AS (SELECT DISTINCT make_date(CAST(year(o_orderdate) AS INTEGER), 1, 1) AS ds FROM orders)
SELECT strftime(ds + CAST(k AS INTEGER), '%Y-%m-%d') AS ds, 'New Year' AS holiday, CAST(k AS INTEGER) AS day FROM c CROSS JOIN range(-2, 3) r(k)""")
def event_windows(spark, d):
    return S.event_windows(S.event_calendar(_new_years(spark, d))).withColumn("ds", F.col("ds").cast("string"))


_DAILY = """daily AS (SELECT CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) / 1e6 AS y, avg(o_totalprice) * 1e-5 AS yhat FROM orders GROUP BY 1)"""


def daily_orders(spark, d):
    """Daily order totals, with the mean order standing in for a forecast."""
    return table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ds")).agg(
        (F.sum("o_totalprice") / 1e6).alias("y"), (F.avg("o_totalprice") * 1e-5).alias("yhat"))


@query("year_split", """
SELECT CASE WHEN year(o_orderdate) < 2000 THEN 'train' ELSE 'test' END AS part, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1""")
def year_split(spark, d):
    train, test = S.split_by_year(daily_orders(spark, d), "ds", 2000)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("days"))


@query("verification_table", f"""
WITH {_DAILY} SELECT strftime(ds, '%Y-%m-%d') AS ds, round(greatest(yhat - 1.5, 0.0), 4) AS yhat, round(y, 4) AS y FROM daily""")
def verification_table(spark, d):
    daily = daily_orders(spark, d)
    forecast = daily.select("ds", (F.col("yhat") - 1.5).alias("yhat"))
    v = S.verification(forecast, daily.select("ds", "y"))
    return rounded(v, ["yhat", "y"], 4).withColumn("ds", F.col("ds").cast("string"))


_SPLIT = "CASE WHEN year(ds) < 2000 THEN 'train' ELSE 'test' END AS split"


@query("accuracy_by_split", f"""
WITH {_DAILY} SELECT {_SPLIT}, round(corr(yhat, y), 6) AS r, round(pow(corr(yhat, y), 2), 6) AS r2,
  round(avg(abs(yhat - y)), 6) AS mae, count(*) AS n FROM daily GROUP BY 1""")
def accuracy_by_split(spark, d):
    return rounded(S.accuracy(S.with_split(daily_orders(spark, d), "ds", 2000), ["split"]), ["r", "r2", "mae"])


@query("residual_distribution", f"""
WITH {_DAILY}, e AS (SELECT {_SPLIT}, yhat - y AS e FROM daily), m AS (SELECT split, avg(e) AS m FROM e GROUP BY split)
SELECT split, round(avg(pow(e - m, 3)) / pow(avg(pow(e - m, 2)), 1.5), 6) AS skewness, round(quantile_cont(e, 0.5), 6) AS median,
       round(avg(e), 6) AS mean FROM e JOIN m USING (split) GROUP BY split""")
def residual_distribution(spark, d):
    return rounded(S.residual_summary(S.with_split(daily_orders(spark, d), "ds", 2000), ["split"]), ["skewness", "median", "mean"])


@query("monthly_correlation", f"""
WITH {_DAILY} SELECT {_SPLIT}, CAST(month(ds) AS INTEGER) AS month, round(corr(yhat, y), 6) AS r, count(*) AS n FROM daily GROUP BY 1, 2""")
def monthly_correlation(spark, d):
    return rounded(S.monthly_correlation(S.with_split(daily_orders(spark, d), "ds", 2000), ["split"]), ["r"])


@query("predicted_against_observed", f"""
WITH {_DAILY} SELECT round(regr_slope(y, yhat), 6) AS slope, round(regr_intercept(y, yhat), 6) AS intercept,
  round(corr(y, yhat), 6) AS r, round(regr_r2(y, yhat), 6) AS r2 FROM daily""")
def predicted_against_observed(spark, d):
    return rounded(S.fit_line(daily_orders(spark, d)), ["slope", "intercept", "r", "r2"])


@query("forecast_histograms", f"""
WITH {_DAILY}, v AS (SELECT 'y' AS metric, y AS v FROM daily UNION ALL SELECT 'yhat', yhat FROM daily UNION ALL SELECT 'residual', yhat - y FROM daily),
l AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM v GROUP BY metric),
c AS (SELECT metric, least(floor((v - lo) / (hi - lo) * 30), 29) AS bin, count(*) AS n FROM v JOIN l USING (metric) GROUP BY ALL)
SELECT l.metric, CAST(b AS INTEGER) AS bin, round(lo + (hi - lo) / 30 * b, 5) + 0.0 AS bin_low, round(lo + (hi - lo) / 30 * (b + 1), 5) + 0.0 AS bin_high,
       coalesce(n, 0) AS count FROM l CROSS JOIN range(30) r(b) LEFT JOIN c ON c.metric = l.metric AND c.bin = b""")
def forecast_histograms(spark, d):
    daily = daily_orders(spark, d).withColumn("residual", F.col("yhat") - F.col("y"))
    return rounded(histograms(daily, ["y", "yhat", "residual"], 30, standardize=False), ["bin_low", "bin_high"], 5)


@query("regressors_on_daily_series", """
WITH daily AS (SELECT CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY 1),
w AS (SELECT CAST(l_shipdate AS DATE) AS ds, avg(l_quantity) AS temp, avg(l_discount) AS rain FROM lineitem
      WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1)
SELECT strftime(ds, '%Y-%m-%d') AS ds, round(y, 4) AS y, round(temp, 4) AS temp, round(rain, 4) AS rain FROM daily LEFT JOIN w USING (ds)""")
def regressors_on_daily_series(spark, d):
    li = table(spark, d, "lineitem")
    prepared = [
        S.regressor_series(li, "l_shipdate", c, n, "1996-01-01", "1999-12-31")
        for c, n in (("l_quantity", "temp"), ("l_discount", "rain"))
    ]
    out = S.attach_regressors(daily_orders(spark, d).select("ds", "y"), prepared)
    return rounded(out, ["y", "temp", "rain"], 4).withColumn("ds", F.col("ds").cast("string"))
