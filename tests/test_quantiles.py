"""Exact quantiles by narrowing ranges, against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlake.operators import joins, quantiles
from trendlake.sources import files

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def columns_of():
    rng = np.random.default_rng(9)
    n = 400
    yield "normal", rng.normal(size=n)
    yield "ties", rng.integers(0, 4, n).astype(float)
    yield "one value", np.full(n, 2.5)
    yield "tails", np.r_[rng.normal(size=n - 3), [1e300, -1e300, 1.7e308]]
    yield "tiny", np.r_[rng.integers(0, 3, n - 2) * 5e-324, [-5e-324, 0.0]]
    yield "decades", 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n)
    yield "infinite", np.r_[rng.normal(size=n - 4), [np.inf, np.inf, -np.inf, np.inf]]


@pytest.mark.parametrize("bins", [256, 1 << 14])
def test_quantiles_equal_sorting(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    data = dict(columns_of())
    names = list(data)
    df = spark.createDataFrame([tuple(map(float, row)) for row in zip(*data.values())], [f"c{i}" for i in range(len(names))])
    got = {r["metric"]: r for r in quantiles.group_quantiles(df, [], df.columns, PROBS, extra=[F.count("value").alias("m")]).collect()}
    for i, name in enumerate(names):
        v = np.sort(data[name])
        assert got[f"c{i}"]["n"] == got[f"c{i}"]["m"] == len(v)
        for p, q in zip(PROBS, got[f"c{i}"]["q"]):
            at = p * (len(v) - 1)
            low, high = v[int(np.floor(at))], v[int(np.ceil(at))]
            want = low if low == high else low + (at - np.floor(at)) * (high - low)
            assert q == pytest.approx(want, rel=1e-12, abs=0, nan_ok=True), (name, p)


def test_quantiles_per_group_with_missing_values(spark):
    rows = [("hot", float(i % 97)) for i in range(600)] + [(None, 1.0), (None, None), ("a", float("nan")), ("a", 3.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in quantiles.group_quantiles(df, ["g"], ["v"], [0.0, 0.5, 1.0]).collect()}
    assert set(got) == {"hot", None, "a"} and got[None]["q"] == [1.0, 1.0, 1.0]
    assert got["hot"]["q"] == [0.0, float(np.median([i % 97 for i in range(600)])), 96.0]
    assert got["a"]["q"][0] == 3.0 and np.isnan(got["a"]["q"][2])


def test_no_value_is_sorted_in_one_window(spark):
    df = spark.range(5000).select(F.rand(1).alias("v"))
    plan = quantiles.group_quantiles(df, [], ["v"], [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_labels_are_numbered_without_one_window(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(200)] + [(None,)], "prediction int")
    got = {r["prediction"]: r["new_label"] for r in joins.dense_labels(df).collect()}
    assert got == {v: i for i, v in enumerate([None, *range(50)])}


def test_extract_does_not_depend_on_the_layout(spark):
    df = spark.range(3000).select("id", F.lit("2001-02-03").alias("d"))
    one, two = (files.chart_extract(x, "d", 0.2, 5) for x in (df.repartition(1), df.repartition(13)))
    a, b = {r["id"] for r in one.collect()}, {r["id"] for r in two.collect()}
    assert a == b and 450 < len(a) < 750
