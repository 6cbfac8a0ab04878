"""Regression and forecast queries on daily order totals and yearly level tables.

A trend with one step has a closed form, so those fits are stated in SQL; fits
with more terms are checked against generated series in the tests.
"""

from pyspark.sql import functions as F

from trendlake.operators import forecast as R
from trendlake.operators import series as S
from trendlake.operators.trends import innovation_levels
from trendlake.queries.base import DIMS, query, rounded, space, table
from trendlake.queries.q_series import daily_orders

_FIT = """d AS (SELECT CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY 1),
lim AS (SELECT min(date_diff('day', DATE '1970-01-01', ds)) AS lo, max(date_diff('day', DATE '1970-01-01', ds)) AS hi FROM d WHERE year(ds) < 2000),
x AS (SELECT ds, y, (date_diff('day', DATE '1970-01-01', ds) - lo) / CAST(hi - lo AS DOUBLE) AS t,
             CASE WHEN year(ds) >= 1998 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM d, lim),
m AS (SELECT count(*) AS n, avg(t) AS mt, avg(s) AS ms, avg(y) AS my, covar_pop(t, t) AS tt, covar_pop(s, s) AS ss, covar_pop(t, s) AS ts,
             covar_pop(t, y) AS ty, covar_pop(s, y) AS sy FROM x WHERE year(ds) < 2000),
b AS (SELECT *, (ty * ss - sy * ts) / (tt * ss - ts * ts) AS bt, (sy * tt - ty * ts) / (tt * ss - ts * ts) AS bs FROM m),
f AS (SELECT *, my - bt * mt - bs * ms AS b0 FROM b),
e AS (SELECT sum(pow(y - b0 - bt * t - bs * s, 2)) / (max(n) - 3) AS s2 FROM x, f WHERE year(ds) < 2000)"""
_DESIGN = R.Design(event_years=(1998,), ramps=False)


def _parts(spark, d):
    daily = daily_orders(spark, d).select("ds", "y")
    return daily, *S.split_by_year(daily, "ds", 2000)


@query("intervention_coefficients", f"""
WITH {_FIT}, c AS (
  SELECT 'intercept' AS term, b0 AS c, sqrt(s2 / n * (1 + (mt * mt * ss - 2 * mt * ms * ts + ms * ms * tt) / (tt * ss - ts * ts))) AS se FROM f, e
  UNION ALL SELECT 'trend', bt, sqrt(s2 / n * ss / (tt * ss - ts * ts)) FROM f, e
  UNION ALL SELECT 'step_1998', bs, sqrt(s2 / n * tt / (tt * ss - ts * ts)) FROM f, e)
SELECT term, round(c, 5) AS coefficient, round(c - 1.96 * se, 5) AS lower, round(c + 1.96 * se, 5) AS upper FROM c""")
def intervention_coefficients(spark, d):
    _, train, _ = _parts(spark, d)
    return rounded(R.fit(train, _DESIGN).coefficient_table(spark), ["coefficient", "lower", "upper"], 5)


@query("forecast_with_interval", f"""
WITH {_FIT} SELECT strftime(ds, '%Y-%m-%d') AS ds, round(b0 + bt * t + bs * s, 5) AS yhat,
  round(b0 + bt * t + bs * s - 1.2815515655446004 * sqrt(s2), 5) AS yhat_lower,
  round(b0 + bt * t + bs * s + 1.2815515655446004 * sqrt(s2), 5) AS yhat_upper FROM x, f, e""")
def forecast_with_interval(spark, d):
    daily, train, _ = _parts(spark, d)
    out = R.fit(train, _DESIGN).predict(daily)
    return rounded(out, ["yhat", "yhat_lower", "yhat_upper"], 5).withColumn("ds", F.col("ds").cast("string"))


@query("future_days", """
WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS last FROM orders)
SELECT strftime(last + CAST(k AS INTEGER), '%Y-%m-%d') AS ds FROM m CROSS JOIN range(1, 31) r(k)""")
def future_days(spark, d):
    daily, _, _ = _parts(spark, d)
    return R.future_frame(daily, 30, with_history=False).select(F.col("ds").cast("string").alias("ds"))


@query("forecast_components", f"""
WITH {_FIT} SELECT strftime(ds, '%Y-%m-%d') AS ds, round(b0 + bt * t, 5) AS trend, round(bs * s, 5) + 0.0 AS step_1998 FROM x, f""")
def forecast_components(spark, d):
    daily, train, _ = _parts(spark, d)
    out = R.fit(train, _DESIGN).components(daily)
    return rounded(out, ["trend", "step_1998"], 5).withColumn("ds", F.col("ds").cast("string"))


@query("forecast_accuracy_by_split", f"""
WITH {_FIT}, v AS (SELECT CASE WHEN year(ds) < 2000 THEN 'train' ELSE 'test' END AS split, y, greatest(b0 + bt * t + bs * s, 0) AS yhat FROM x, f)
SELECT split, round(corr(yhat, y), 5) AS r, round(pow(corr(yhat, y), 2), 5) AS r2, round(avg(abs(yhat - y)), 5) AS mae, count(*) AS n FROM v GROUP BY split""")
def forecast_accuracy_by_split(spark, d):
    daily, train, _ = _parts(spark, d)
    v = S.with_split(S.verification(R.fit(train, _DESIGN).predict(daily), daily), "ds", 2000)
    return rounded(S.accuracy(v, ["split"]), ["r", "r2", "mae"], 5)


def _calendar(spark, d):
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return years.select(F.make_date("y", F.lit(1), F.lit(1)).alias("ds"), F.lit("New Year").alias("holiday"))


_FULL = R.Design(
    cycles=(("yearly", 365.25, 10), ("weekly", 7.0, 3)), holidays=("New Year",), multiplicative=True,
)


@query("seasonal_multiplicative_forecast")
def seasonal_multiplicative_forecast(spark, d):
    daily, train, _ = _parts(spark, d)
    out = R.fit(train, _FULL, _calendar(spark, d)).predict(daily)
    return rounded(out, ["yhat", "yhat_lower", "yhat_upper"], 4).withColumn("ds", F.col("ds").cast("string"))


@query("forecast_with_regressors")
def forecast_with_regressors(spark, d):
    daily, train, _ = _parts(spark, d)
    li = table(spark, d, "lineitem")
    regressors = [
        S.regressor_series(li, "l_shipdate", c, n, "1995-01-01", "2001-12-31")
        for c, n in (("l_quantity", "temp"), ("l_discount", "rain"))
    ]
    design = R.Design(cycles=_FULL.cycles, regressors=("temp", "rain"), multiplicative=True)
    fitted = R.fit(S.attach_regressors(train, regressors), design)
    out = R.forecast_with_regressors(fitted, daily, 30, regressors)
    return rounded(out, ["yhat", "yhat_lower", "yhat_upper"], 4).withColumn("ds", F.col("ds").cast("string"))


@query("changepoint_trend_fit")
def changepoint_trend_fit(spark, d):
    _, train, _ = _parts(spark, d)
    fitted = R.fit(train, R.Design(cycles=(("yearly", 365.25, 3),), changepoints=25, ridge=0.01))
    return rounded(fitted.coefficient_table(spark).select("term", "coefficient"), ["coefficient"], 5)


# One hinge at 0.8 of the training range beside the trend: both the plain and the sparse fit have closed forms.
_HINGE = """d AS (SELECT CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY 1),
lim AS (SELECT min(date_diff('day', DATE '1970-01-01', ds)) AS lo, max(date_diff('day', DATE '1970-01-01', ds)) AS hi, max(ds) AS last FROM d WHERE year(ds) < 2000),
x AS (SELECT ds, y, (date_diff('day', DATE '1970-01-01', ds) - lo) / CAST(hi - lo AS DOUBLE) AS t FROM d, lim WHERE year(ds) < 2000),
m AS (SELECT count(*) AS n, avg(t) AS mt, avg(h) AS mh, avg(y) AS my, stddev_pop(t) AS st, stddev_pop(h) AS sh, corr(t, h) AS r,
             covar_pop(t, y) / stddev_pop(t) AS ty, covar_pop(h, y) / stddev_pop(h) AS hy FROM (SELECT *, greatest(t - 0.8::DOUBLE, 0) AS h FROM x)),
p AS (SELECT *, hy - r * ty AS pull FROM m),
b AS (SELECT *, sign(pull) * greatest(abs(pull) - {size}, 0) / (1 - r * r) AS zh FROM p),
f AS (SELECT *, zh / sh AS bh, (ty - r * zh) / st AS bt FROM b),
g AS (SELECT *, my - bt * mt - bh * mh AS b0 FROM f),
e AS (SELECT sum(pow(y - b0 - bt * t - bh * greatest(t - 0.8::DOUBLE, 0), 2)) AS sse FROM x, g)"""


@query("sparse_changepoint_fit", "WITH " + _HINGE.format(size="0.001::DOUBLE") + """
SELECT 'trend' AS term, round(bt, 5) AS value FROM g UNION ALL SELECT 'hinge_1', round(bh, 5) + 0.0 FROM g UNION ALL SELECT 'intercept', round(b0, 5) FROM g
UNION ALL SELECT 'residual_sum', round(sse, 5) FROM e""")
def sparse_changepoint_fit(spark, d):
    _, train, _ = _parts(spark, d)
    fitted = R.fit(train, R.Design(changepoints=1, sparse=(("changepoints", 0.001),)))
    terms = fitted.coefficient_table(spark).select("term", F.col("coefficient").alias("value"))
    seen = fitted.predict(train).join(train, "ds")
    return rounded(terms.unionByName(seen.agg(F.lit("residual_sum").alias("term"), F.sum((F.col("y") - F.col("yhat")) ** 2).alias("value"))), ["value"], 5)


@query("sparse_changepoint_terms")
def sparse_changepoint_terms(spark, d):
    _, train, _ = _parts(spark, d)
    design = R.Design(cycles=(("yearly", 365.25, 3),), changepoints=25, sparse=(("changepoints", 0.002),))
    return rounded(R.fit(train, design).coefficient_table(spark).select("term", "coefficient"), ["coefficient"], 5)


# Chances are hashes of seed, draw and day, so SQL draws the same future slope changes.
_CHANCE = "(('0x' || substr(md5('7|' || draw || '|' || strftime(ds, '%Y-%m-%d') || '|{name}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
_DRAWS = f"""WITH {_HINGE.format(size="0.0::DOUBLE")},
day AS (SELECT last + CAST(k AS INTEGER) AS ds, lo, hi FROM lim, range(1, 366) r(k)),
u AS (SELECT ds, draw, (date_diff('day', DATE '1970-01-01', ds) - lo) / CAST(hi - lo AS DOUBLE) AS t, hi - lo AS days,
             {_CHANCE.format(name="change")} AS uc, {_CHANCE.format(name="size")} - 0.5 AS us, {_CHANCE.format(name="noise")} AS un,
             {_CHANCE.format(name="angle")} AS ua FROM day, range(1, 201) k(draw)),
c AS (SELECT u.*, CASE WHEN uc < 1.0::DOUBLE / days THEN -abs(bh) * sign(us) * ln(greatest(1 - 2 * abs(us), 1e-16::DOUBLE)) ELSE 0.0 END AS d FROM u, g),
w AS (SELECT ds, t, t * sum(d) OVER o - sum(d * t) OVER o + sqrt(sse / (n - 3)) * sqrt(-2 * ln(1 - un)) * cos(ua * 2 * pi()) AS err
      FROM c, e, m WINDOW o AS (PARTITION BY draw ORDER BY ds)),
z AS (SELECT ds, max(t) AS t, quantile_cont(err, 0.1) AS lo, quantile_cont(err, 0.9) AS hi FROM w GROUP BY ds)
SELECT strftime(ds, '%Y-%m-%d') AS ds, round(y, 4) AS yhat, round(y + lo, 4) AS yhat_lower, round(y + hi, 4) AS yhat_upper
FROM (SELECT z.*, b0 + bt * t + bh * (t - 0.8::DOUBLE) AS y FROM z, g)"""


@query("forecast_widening_interval", _DRAWS)
def forecast_widening_interval(spark, d):
    _, train, _ = _parts(spark, d)
    fitted = R.fit(train, R.Design(changepoints=1))
    out = fitted.predict_by_draws(R.future_frame(train, 365, with_history=False), 200, seed=7)
    return rounded(out, ["yhat", "yhat_lower", "yhat_upper"], 4).withColumn("ds", F.col("ds").cast("string"))


_EDGES = [0.0, 0.95, 1.05, 100.0]
_YEARLY = R.Design(cycles=(("long_cycle", 40 * 365.25, 1),), event_years=(1999,))


def _levels(spark, d):
    return innovation_levels(space(spark, d), "score", _EDGES, dims=DIMS)


@query("level_intervention_coefficients")
def level_intervention_coefficients(spark, d):
    models = R.fit_levels(_levels(spark, d), _EDGES, _YEARLY)
    return rounded(R.level_coefficients(models, spark, ["step_1999", "ramp_1999"]), ["coefficient", "lower", "upper"], 4)


@query("half_split_replication")
def half_split_replication(spark, d):
    out = R.half_split_replication(space(spark, d), ["vec_id"], "score", _EDGES, _YEARLY, dims=DIMS)
    return rounded(out, ["r", "r2", "mae"], 4)
