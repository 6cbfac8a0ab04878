import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trendlake.operators import density, grid, series
from trendlake.operators.smooth import loess

XY = ["u", "v"]


def test_bin_conventions(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.24, 0.25, 0.99, 1.0, 2.0)], "v double")
    lo, hi = F.lit(0.0), F.lit(1.0)
    got = df.select(*[grid.bin_index(F.col("v"), lo, hi, 4, e).alias(e) for e in grid.EDGES]).collect()
    assert [r["clamp"] for r in got] == [0, 0, 0, 1, 3, 3, 3]
    assert [r["close"] for r in got] == [None, 0, 0, 1, 3, 3, None]
    assert [r["digitize"] for r in got] == [-1, 0, 0, 1, 3, 4, 4]
    flat = df.select(grid.bin_index(F.col("v"), F.lit(1.0), F.lit(1.0), 4).alias("b")).collect()
    assert {r["b"] for r in flat} == {0}


def test_clamped_grid_counts_every_row(points):
    g = grid.yearly_grid(points, XY, 10)
    assert g.agg(F.sum("count")).first()[0] == points.count()
    dense = grid.dense_grid(g, 10)
    assert dense.count() == 4 * 100 and dense.agg(F.sum("count")).first()[0] == points.count()


def test_histogram_matches_numpy(points):
    x = np.array([r["u"] for r in points.collect()])
    z = (x - x.mean()) / x.std(ddof=1)
    want, edges = np.histogram(z, 30)
    got = grid.histograms(points, ["u"], 30).orderBy("bin").collect()
    assert [r["count"] for r in got] == list(want) and got[3]["bin_low"] == pytest.approx(edges[3])
    mid = grid.histogram_centres(points, ["u"]).first()
    assert mid["median"] == pytest.approx(np.median(z)) and mid["mean"] == 0.0


def test_histogram_2d_matches_numpy(points):
    rows = points.collect()
    u, v, y = (np.array([r[c] for r in rows]) for c in ("u", "v", "year"))
    want, _, _ = np.histogram2d(u[y == 2001], v[y == 2001], bins=[np.linspace(u.min(), u.max(), 8), np.linspace(v.min(), v.max(), 8)])
    got = np.zeros((7, 7))
    for r in grid.yearly_histogram_2d(points, XY, 8).filter("year = 2001").collect():
        got[r["x_bin"], r["y_bin"]] = r["count"]
    assert (got == want).all()


def test_density_matches_direct_sum(points):
    rows = points.collect()
    u, y = np.array([r["u"] for r in rows]), np.array([r["year"] for r in rows])
    x = np.linspace(u.min(), u.max(), 50)
    mine = u[y == 2001]
    h = mine.std(ddof=1) * len(mine) ** -0.2
    want = np.exp(-0.5 * ((x[:, None] - mine[None, :]) / h) ** 2).mean(axis=1) / (h * np.sqrt(2 * np.pi))
    curves = density.density_curves(points, XY, 2, points=50)
    got = curves.filter("period = 2001 AND dim = 0").orderBy("point").collect()
    assert [r["density"] for r in got] == pytest.approx(list(want))
    rough = density.density_curves(points, XY, 2, points=50, prebin=4096).filter("period = 2001 AND dim = 0").orderBy("point").collect()
    assert [r["density"] for r in rough] == pytest.approx(list(want), abs=1e-5)


def test_density_skips_periods_without_spread(spark):
    df = spark.createDataFrame([(2000, 1.0, 1.0), (2001, 1.0, 1.0), (2001, 1.0, 2.0)], "year int, a double, b double")
    got = {(r["period"], r["dim"]) for r in density.density_curves(df, ["a", "b"], points=5).collect()}
    assert got == {(2001, 1)}


def test_loess_reproduces_a_parabola(spark):
    rows = [("a", 2000 + i, 0.5 * i * i - i + 2.0) for i in range(12)] + [("single", 2000, 7.0)] + [("pair", 2000, 1.0), ("pair", 2001, 2.0)]
    got = {(r["g"], r["year"]): r["smooth"] for r in loess(spark.createDataFrame(rows, "g string, year int, mean_val double"), ["g"]).collect()}
    for i in range(12):
        assert got["a", 2000 + i] == pytest.approx(0.5 * i * i - i + 2.0)
    assert got["single", 2000] == 7.0 and got["pair", 2000] == 1.0


def hours(spark, values):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, y double").repartition(3)


@pytest.mark.parametrize("window,periods", [(5, 5), (6, 6), (7, 3), (6, 2)])
def test_rolling_mean_matches_pandas(spark, window, periods):
    v = [float(x) if x % 7 else None for x in range(40)]
    got = [r["rolling"] for r in series.rolling_mean(hours(spark, v), "ts", "y", window, periods).orderBy("ts").collect()]
    want = pd.Series(v, dtype=float).rolling(window, center=True, min_periods=periods).mean()
    assert [None if pd.isna(x) else pytest.approx(x) for x in want] == got


def test_rolling_corr_matches_pandas(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=60), rng.normal(size=60)
    df = hours(spark, [float(x) for x in a]).join(hours(spark, [float(x) for x in b]).withColumnRenamed("y", "z"), "ts")
    got = [r["rolling_r"] for r in series.rolling_corr(df, "ts", "y", "z", 9).orderBy("ts").collect()]
    want = pd.Series(a).rolling(9, center=True).corr(pd.Series(b))
    assert [None if pd.isna(x) else pytest.approx(x) for x in want] == got


def test_interpolation_matches_pandas(spark):
    v = [None, None, 1.0, None, None, 4.0, 5.0, None, 9.0, None, None]
    got = [r["y"] for r in series.interpolate(hours(spark, v), "ts", "y").orderBy("ts").collect()]
    want = pd.Series(v, dtype=float).interpolate()
    assert [None if pd.isna(x) else pytest.approx(x) for x in want] == got


def test_median_filter_removes_a_spike(spark):
    v = [10.0 + (i % 3) for i in range(60)]
    v[30] = 500.0
    got = [r["y"] for r in series.median_filter(hours(spark, v), "ts", "y").orderBy("ts").collect()]
    assert got[30] is None and sum(x is None for x in got) == 1


def test_daily_sum_fills_missing_days(spark):
    rows = [(dt.datetime(2024, 1, 1, 3), 2.0), (dt.datetime(2024, 1, 1, 9), None), (dt.datetime(2024, 1, 4, 1), 5.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    assert [r["y"] for r in series.daily_sum(df, "ts", "v").orderBy("ds").collect()] == [2.0, 0.0, 0.0, 5.0]


def test_split_has_no_overlap(spark):
    df = spark.createDataFrame([(dt.date(2016, 12, 31),), (dt.date(2017, 1, 1),), (dt.date(2017, 12, 31),)], "ds date")
    train, test = series.split_by_year(df, "ds", 2017)
    assert train.count() == 1 and test.count() == 2


def test_event_windows(spark):
    df = spark.createDataFrame([("2018-01-01", "New Year (Observed)"), ("2018-01-01", "New Year")], "ds string, holiday string")
    days = series.event_windows(series.event_calendar(df)).orderBy("ds").collect()
    assert [(str(r["ds"]), r["day"]) for r in days] == [(f"201{'7-12-30' if k == -2 else '7-12-31' if k == -1 else f'8-01-0{k + 1}'}", k) for k in range(-2, 3)]


def test_accuracy_and_residuals(spark):
    y, p = np.array([1.0, 2.0, 4.0, 3.0]), np.array([1.5, 1.0, 3.0, 5.0])
    df = spark.createDataFrame(pd.DataFrame({"y": y, "yhat": p}))
    a, r = series.accuracy(df).first(), series.residual_summary(df).first()
    e = p - y
    assert a["r"] == pytest.approx(np.corrcoef(y, p)[0, 1]) and a["mae"] == pytest.approx(np.abs(e).mean())
    m = e - e.mean()
    assert r["skewness"] == pytest.approx((m**3).mean() / (m**2).mean() ** 1.5) and r["median"] == np.median(e)


def test_stream_gives_the_daily_sums(spark, tmp_path):
    from trendlake.streaming.daily import daily_sum_stream

    rows = [(dt.datetime(2024, 1, 1, h), 1.0) for h in range(5)] + [(dt.datetime(2024, 1, 2, 1), 2.0), (dt.datetime(2024, 1, 9, 0), 0.0)]
    df = spark.createDataFrame(rows, "ts timestamp, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = (
        daily_sum_stream(stream, "ts", "v").writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = {str(r["ds"]): r["y"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01": 5.0, "2024-01-02": 2.0}
