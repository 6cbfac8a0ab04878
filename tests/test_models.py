import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlake.operators import basket, cluster, dbscan, features, forecast, hierarchy, joins, series
from trendlake.operators.components import connected_components


def plane(spark, xy, parts=4):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, a double, b double").repartition(parts)


def slow_dbscan(x, eps, m):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= m
    comp = np.where(core, np.arange(len(x)), len(x) + 1)
    while True:
        new = np.array([min(comp[near[i] & core]) if core[i] else comp[i] for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    firsts = {c: k for k, c in enumerate(sorted(set(comp[core])))}
    out = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i]:
            out[i] = firsts[comp[i]]
        elif (near[i] & core).any():
            out[i] = min(firsts[comp[j]] for j in np.flatnonzero(near[i] & core))
    return out


RNG = np.random.default_rng(11)
RING = np.c_[np.cos(np.linspace(0, 6.2, 150)), np.sin(np.linspace(0, 6.2, 150))]
CASES = {
    "blobs": (np.r_[RNG.normal(0, 0.1, (80, 2)), RNG.normal(2, 0.1, (60, 2)), RNG.uniform(-1, 3, (40, 2))], 0.25, 5),
    "ring": (np.r_[RING, RNG.normal(0, 0.05, (60, 2))], 0.12, 3),
    "copies": (np.r_[np.repeat([[0.0, 0.0]], 90, 0), np.repeat([[0.3, 0.0]], 4, 0), [[0.15, 0.0], [5.0, 5.0]]], 0.2, 6),
    # Two dense strips whose gap is close to eps: boxes must be split to decide.
    "near gap": (np.r_[RNG.uniform(0, 1, (150, 2)) * [0.3, 1.0], RNG.uniform(0, 1, (150, 2)) * [0.3, 1.0] + [0.55, 0.0]], 0.25, 4),
    "exact gap": (np.array([[0.0, 0.0], [0.0, 0.1], [0.5, 0.0], [0.5, 0.1], [1.0 + 1e-12, 0.0]]), 0.5, 2),
    "sparse": (RNG.uniform(-50, 50, (60, 2)), 0.5, 3),
}


@pytest.mark.parametrize("name", CASES)
def test_dbscan_equals_brute_force(spark, name):
    x, eps, m = CASES[name]
    got = {r["id"]: r["cluster"] for r in dbscan.dbscan(plane(spark, x), "id", ["a", "b"], eps, m, standardize=False).collect()}
    assert [got[i] for i in range(len(x))] == list(slow_dbscan(x, eps, m))


def test_dbscan_salts_do_not_change_labels(spark, monkeypatch):
    x, eps, m = CASES["blobs"]
    monkeypatch.setattr(dbscan, "_SALT_ROWS", 3)
    got = {r["id"]: r["cluster"] for r in dbscan.dbscan(plane(spark, x), "id", ["a", "b"], eps, m, standardize=False).collect()}
    assert [got[i] for i in range(len(x))] == list(slow_dbscan(x, eps, m))


def test_dbscan_direct_check_of_last_boxes(spark, monkeypatch):
    x, eps, m = CASES["near gap"]
    monkeypatch.setattr(dbscan, "_ROUNDS", 1)
    got = {r["id"]: r["cluster"] for r in dbscan.dbscan(plane(spark, x), "id", ["a", "b"], eps, m, standardize=False).collect()}
    assert [got[i] for i in range(len(x))] == list(slow_dbscan(x, eps, m))


def test_dbscan_sweep(spark):
    x, _, _ = CASES["blobs"]
    out = dbscan.dbscan_sweep(plane(spark, x), "id", ["a", "b"], [0.3], [5, 10], standardize=False)
    assert out.count() == 2 and dbscan.best_setting(out).count() == 1


def test_components_on_a_long_path(spark):
    nodes = spark.range(60)
    edges = spark.createDataFrame([(i, i + 1) for i in range(39)] + [(50, 45), (45, 55)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(40)) and got[45] == got[50] == got[55] == 45 and got[59] == 59


def slow_tree(x, method):
    groups, heights, snaps = [[i] for i in range(len(x))], [], []

    def gap(g, h):
        d = np.sqrt(((x[g][:, None] - x[h][None]) ** 2).sum(2))
        if method == "ward":
            diff = x[g].mean(0) - x[h].mean(0)
            return np.sqrt(2.0 * len(g) * len(h) / (len(g) + len(h)) * (diff @ diff))
        return {"single": d.min(), "complete": d.max(), "average": d.mean()}[method]

    while len(groups) > 1:
        snaps.append([sorted(g) for g in groups])
        h, i, j = min((gap(groups[i], groups[j]), i, j) for i, j in itertools.combinations(range(len(groups)), 2))
        heights.append(h)
        groups[i] = groups[i] + groups[j]
        del groups[j]
    snaps.append([sorted(groups[0])])
    return heights, snaps


def slow_linkage(x, height):
    label = list(range(len(x)))
    for i in range(len(x)):
        for j in range(i):
            if np.hypot(*(x[i] - x[j])) <= height and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    return label


@pytest.mark.parametrize("n", [40, 700])
def test_single_linkage_equals_brute_force(spark, n):
    x = np.random.default_rng(7).normal(size=(n, 2))
    out = hierarchy.single_linkage(plane(spark, x), "id", ["a", "b"], 0.12, standardize=False).collect()
    assert {r["id"]: r["cluster"] for r in out} == dict(enumerate(slow_linkage(x, 0.12)))


def test_groups_do_not_change_each_other(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 0.02, (70, 2)), rng.normal(1, 0.02, (60, 2)), rng.normal(0, 30, (700, 2))]
    df = plane(spark, x).withColumn("g", F.when(F.col("id") < 130, "b").otherwise("a"))
    alone = hierarchy.single_linkage(df.filter("g = 'b'"), "id", ["a", "b"], 0.2, by=["g"], standardize=False)
    beside = hierarchy.single_linkage(df, "id", ["a", "b"], 0.2, by=["g"], standardize=False).filter("g = 'b'")
    got = {r["id"]: r["cluster"] for r in beside.collect()}
    assert got == {r["id"]: r["cluster"] for r in alone.collect()}
    assert set(got.values()) == {0, 70}


def test_pca_and_svd_against_numpy(spark):
    x = np.random.default_rng(9).normal(size=(200, 4)) @ np.diag([3.0, 2.0, 1.0, 0.1]) + [1.0, 0.0, 2.0, 0.0]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *[float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double, d double").repartition(5)
    rows = features.assemble(df, names, "v")
    fit = features.fit_pca(rows, "v", 4, threshold=0.9)
    w = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert fit.variance == pytest.approx(list(w / w.sum())) and sum(fit.variance) == pytest.approx(1.0)
    assert fit.components == int(np.flatnonzero(np.cumsum(w / w.sum()) >= 0.9)[0]) + 1
    scored = features.reduce_rows(rows, fit, "v", center=True).select("id", "score")
    got = np.array([r["score"] for r in scored.orderBy("id").collect()])
    assert got.shape[1] == fit.components
    assert got == pytest.approx((x - x.mean(0)) @ fit.loadings[:, : fit.components])

    svd = features.fit_svd(rows, "v", 4, threshold=0.9)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert svd.variance == pytest.approx(list(s**2 / (s**2).sum()))
    got = np.array([r["score"] for r in features.reduce_rows(rows, svd, "v").orderBy("id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(u[:, : svd.components]), abs=1e-8)


def test_one_strong_component_is_one_component(spark):
    x = np.random.default_rng(1).normal(size=100)
    df = spark.createDataFrame([(float(v), float(v) * 2 + 1e-6 * i) for i, v in enumerate(x)], "a double, b double")
    assert features.fit_pca(features.assemble(df, ["a", "b"], "v"), "v", 2, 0.95).components == 1


def test_wide_projection_matches_narrow(spark):
    rng = np.random.default_rng(2)
    m, row = rng.normal(size=(40, 10)), rng.normal(size=40)
    df = spark.createDataFrame([([float(v) for v in row],)], "s array<double>")
    assert df.select(features.project(F.col("s"), m, np.ones(10))).first()[0] == pytest.approx(list(row @ m + 1))


@pytest.fixture
def blobs(spark):
    rng = np.random.default_rng(21)
    x = np.r_[rng.normal(0, 0.3, (60, 2)), rng.normal(6, 0.3, (60, 2)), rng.normal([6, -6], 0.3, (60, 2))]
    return plane(spark, x).select("id", F.array("a", "b").alias("score"))


@pytest.mark.parametrize("kind", ["kmeans", "bisecting"])
def test_sweep_finds_the_blobs(spark, blobs, kind):
    s = cluster.sweep(blobs, "score", range(2, 6), seed=1, kind=kind)
    assert s.k == 3 and len(s.scores) == 4 and s.table(spark).count() == 4
    out = s.label(blobs).collect()
    assert len({(r["prediction"], r["id"] // 60) for r in out}) == 3
    assert s.centres(spark).filter("dim = 0").orderBy("prediction").first()["centre"] == pytest.approx(0.0, abs=0.2)
    assert "score" in out[0].asDict()


def test_sampled_and_stable_sweeps(spark, blobs):
    assert cluster.sweep(blobs, "score", [2, 3], sample_keys=["id"]).k == 3  # fewer than 1,000 rows: all are scored
    s = cluster.stable_sweep(blobs, "score", [2, 3], seeds=(1, 2))
    assert s.k in (2, 3) and len(s.scores) == 4 and s.model is not None
    assert cluster.stability_table(s.table(spark)).count() == 2


def test_silhouette_of_one_cluster(spark, blobs):
    one = cluster.with_vector(blobs, "score").withColumn("prediction", F.lit(0))
    assert cluster.silhouette(one, "score") == -1.0


def test_itemsets_against_brute_force(spark):
    rng = np.random.default_rng(6)
    lists = [[str(v) for v in rng.choice(6, size=rng.integers(1, 5))] for _ in range(200)] + [[], ["0", "0"]]
    df = spark.createDataFrame([(l,) for l in lists] + [(None,)], "items array<string>")
    model = basket.mine(df, "items", 0.05, 0.3)
    got = {tuple(r["items"]): r["freq"] for r in basket.frequent_itemsets(model).collect()}
    sets = [set(l) for l in lists]
    want = {}
    for size in range(1, 7):
        for c in itertools.combinations("012345", size):
            n = sum(set(c) <= s for s in sets)
            if n >= 0.05 * len(sets):
                want[c] = n
    assert got == want
    rules = basket.association_rules(model).collect()
    assert rules
    for r in rules:
        a, both = tuple(r["antecedent"]), tuple(sorted([*r["antecedent"], *r["consequent"]]))
        assert r["confidence"] == pytest.approx(want[both] / want[a])
    edges = basket.rule_edges(basket.association_rules(model), 0.3)
    assert basket.node_degrees(edges).agg(F.sum("degree")).first()[0] == 2 * edges.count()


def series_frame(spark, n, f):
    d0 = dt.date(2010, 1, 1)
    return spark.createDataFrame([(d0 + dt.timedelta(days=i), float(f(i))) for i in range(n)], "ds date, y double").repartition(4)


def test_forecast_recovers_known_terms(spark):
    rng = np.random.default_rng(8)
    epoch = (dt.date(2010, 1, 1) - dt.date(1970, 1, 1)).days
    step = (dt.date(2012, 1, 1) - dt.date(2010, 1, 1)).days
    noise = rng.normal(0, 0.05, 1461)
    f = lambda i: 5 + 2 * i / 1460 + 1.5 * np.sin(2 * np.pi * (epoch + i) / 365.25) + (3.0 if i >= step else 0.0) + noise[i]
    df = series_frame(spark, 1461, f)
    m = forecast.fit(df, forecast.Design(cycles=(("yearly", 365.25, 2),), event_years=(2012,)))
    c = {r["term"]: r for r in m.coefficient_table(spark).collect()}
    for term, value in (("trend", 2.0), ("yearly_sin1", 1.5), ("step_2012", 3.0), ("yearly_cos2", 0.0)):
        assert c[term]["coefficient"] == pytest.approx(value, abs=0.05)
        assert c[term]["lower"] < c[term]["coefficient"] < c[term]["upper"]
    assert m.sigma == pytest.approx(0.05, rel=0.1)
    pred = m.predict(df).join(df, "ds").agg(F.avg(((F.col("y") > F.col("yhat_lower")) & (F.col("y") < F.col("yhat_upper"))).cast("int"))).first()[0]
    assert pred == pytest.approx(0.8, abs=0.05)
    parts = m.components(df).drop("ds").columns
    total = m.components(df).select("ds", sum(F.col(p) for p in parts).alias("s")).join(m.predict(df), "ds")
    assert total.agg(F.max(F.abs(F.col("s") - F.col("yhat")))).first()[0] < 1e-9


def test_multiplicative_with_holidays_regressors_and_future(spark):
    df = series_frame(spark, 800, lambda i: np.expm1(1.0 + 0.002 * (i % 10) + (0.5 if i in (365, 730) else 0.0)))
    reg = df.select("ds", (F.dayofyear("ds") % 10).cast("double").alias("temp"))
    cal = spark.createDataFrame([(dt.date(y, 1, 1), "New Year") for y in range(2010, 2014)], "ds date, holiday string")
    design = forecast.Design(regressors=("temp",), holidays=("New Year",), multiplicative=True)
    m = forecast.fit(df.join(reg, "ds"), design, cal)
    c = {r["term"]: r["coefficient"] for r in m.coefficient_table(spark).collect()}
    assert c["holiday_New Year_0"] > 0.1 and "temp" in c
    assert forecast.future_frame(df, 3).count() == 803
    ahead = forecast.future_frame(df, 3, with_history=False)
    assert [str(r["ds"]) for r in ahead.orderBy("ds").collect()] == ["2012-03-11", "2012-03-12", "2012-03-13"]
    assert forecast.future_frame(df, 2, "year", with_history=False).count() == 2
    assert forecast.future_frame(df, 0).count() == 800
    assert forecast.forecast_with_regressors(m, df, 2, [reg]).count() == 802


def test_changepoints_follow_a_bend(spark):
    df = series_frame(spark, 1000, lambda i: 0.01 * i if i < 400 else 4.0 - 0.02 * (i - 400))
    m = forecast.fit(df, forecast.Design(changepoints=25, ridge=1e-4))
    worst = m.predict(df).join(df, "ds").agg(F.max(F.abs(F.col("yhat") - F.col("y")))).first()[0]
    assert worst < 0.3 and m.coefficient_table(spark).filter("lower < upper").count() == 1 + len(m.columns)


def test_half_split_replicates(spark, points):
    design = forecast.Design()
    out = forecast.half_split_replication(points, ["id"], ["u", "v"], [0, 1, 100], design).collect()
    assert [r["range"] for r in out] == ["0.0-1.0", "1.0-100.0"] and all(r["n"] == 4 for r in out)


def test_half_split_with_an_empty_range(spark, points):
    rows = forecast.half_split_replication(points, ["id"], ["u", "v"], [0, 100, 200], forecast.Design()).collect()
    r = {x["range"]: x for x in rows}["100.0-200.0"]
    assert math.isnan(r["r"]) and math.isnan(r["r2"]) and r["mae"] == 0.0 and r["n"] == 4


def test_correlation_of_a_constant(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, None), ("b", 1.0, 2.0), ("b", 2.0, 1.0), ("c", None, 1.0), ("d", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "split string, yhat double, y double")
    got = {r["split"]: r["r"] for r in series.accuracy(df, ["split"]).collect()}
    assert math.isnan(got["a"]) and got["b"] == pytest.approx(-1.0) and got["c"] is None and math.isnan(got["d"])


def test_neighbouring_holidays_share_a_day(spark):
    df = series_frame(spark, 1461, lambda i: 10.0 + (3.0 if (dt.date(2010, 1, 1) + dt.timedelta(days=i)).strftime("%m%d") == "1226" else 0.0))
    days = [(dt.date(y, 12, d), name) for y in range(2010, 2015) for d, name in ((25, "Christmas Day"), (26, "Boxing Day"))]
    cal = spark.createDataFrame(days, "ds date, holiday string")
    design = forecast.Design(holidays=("Christmas Day", "Boxing Day"))
    m = forecast.fit(df, design, cal)
    c = {r["term"]: r for r in m.coefficient_table(spark).collect()}
    both = c["holiday_Christmas Day_1"]["coefficient"] + c["holiday_Boxing Day_0"]["coefficient"]
    assert both == pytest.approx(3.0, abs=0.01) and all(r["lower"] is not None for r in c.values())
    own = forecast.Design(holidays=("Christmas Day", "Boxing Day"), holiday_windows=(("Christmas Day", 0, 0),))
    terms = forecast.fit(df, own, cal).columns
    assert [t for t in terms if "Christmas" in t] == ["holiday_Christmas Day_0"] and len(terms) == 7
    with pytest.raises(ValueError, match="holiday_Boxing Day_0"):
        forecast.fit(df, forecast.Design(holidays=("Christmas Day", "Boxing Day"), penalties=()), cal)


def test_a_regressor_equal_to_time_is_named(spark):
    df = series_frame(spark, 200, lambda i: 1.0 + i).withColumn("late", F.datediff("ds", F.lit("2000-01-01")).cast("double"))
    with pytest.raises(ValueError, match="late"):
        forecast.fit(df, forecast.Design(regressors=("late",)))
    m = forecast.fit(df, forecast.Design(regressors=("late",), penalties=(("late", 0.1),)))
    assert m.predict(df).join(df, "ds").agg(F.max(F.abs(F.col("yhat") - F.col("y")))).first()[0] < 1e-6


def test_penalties_shrink_their_own_terms(spark):
    df = series_frame(spark, 400, lambda i: (1.0 if i % 2 else -1.0) + 0.01 * i).withColumn("flip", F.when(F.datediff("ds", F.lit("2010-01-01")) % 2 == 1, 1.0).otherwise(-1.0))
    c = {r["term"]: r["coefficient"] for r in forecast.fit(df, forecast.Design(regressors=("flip",), penalties=(("flip", 1.0),))).coefficient_table(spark).collect()}
    assert c["flip"] == pytest.approx(0.5, abs=0.01) and c["trend"] == pytest.approx(3.99, abs=0.05)


def test_events_may_have_their_own_window(spark):
    cal = spark.createDataFrame([(dt.date(2010, 5, 1), "a", 0, 1), (dt.date(2010, 6, 1), "b", None, None)], "ds date, holiday string, lower_window int, upper_window int")
    got = {(r["holiday"], r["day"]) for r in series.event_windows(cal, -1, 0).collect()}
    assert got == {("a", 0), ("a", 1), ("b", -1), ("b", 0)}


def test_spread_vectors_come_in_small_parts(spark, monkeypatch):
    df = spark.range(1000, numPartitions=1).select(F.array((F.col("id") % 2 * 9).cast("double"), (F.col("id") % 5).cast("double")).alias("v"))
    parts, fits = [], cluster._fits
    monkeypatch.setattr(cluster, "_fits", lambda rows, *rest: parts.append(rows.rdd.getNumPartitions()) or fits(rows, *rest))
    monkeypatch.setattr(cluster, "PART_ROWS", 60, raising=False)
    assert cluster.sweep(df, "v", [2], partitions=4).k == 2 and parts == [17]


def test_keys_are_spread_over_parts_of_like_size(spark):
    df = spark.range(4000, numPartitions=1).select((F.col("id") % 1000).alias("a"), (F.col("id") % 3).alias("b"))
    out = joins.spread_by_key(df, ["a", "b"], 300)
    assert out.rdd.getNumPartitions() == 14 and out.count() == 4000
    assert out.withColumn("p", F.spark_partition_id()).groupBy("a", "b").agg(F.count_distinct("p").alias("n")).filter("n > 1").isEmpty()
    both = out.groupBy("a", "b").agg(F.count("*").alias("n")).join(out.groupBy("a", "b").agg(F.max("a").alias("m")), ["a", "b"])
    assert both.filter("n > 0 and m = a").count() == 3000
