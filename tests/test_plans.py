import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from trendlake.operators.forecast import Design
from trendlake.plans import flows


def test_tracks_to_clusters_and_measures(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        side = 5.0 if i % 2 else 0.0
        rows.append((f"t{i}", f"a{i % 7}", f"{2000 + i % 5}-03-01", *[float(v) + side for v in rng.normal(0, 0.3, 3)]))
    rows.append(("far", "a1", "1890-01-01", 0.0, 0.0, 0.0))
    rows.append(("gap", "a1", "2001-01-01", None, 0.0, 0.0))
    df = spark.createDataFrame(rows, "id string, artist string, day string, x double, y double, z double").repartition(6)
    out = flows.tracks_to_clusters(df, ["x", "y", "z"], "day", "1921-01-01", "2020-12-31", 0.9, [2, 3], min_cluster=50)
    got = out.rows.collect()
    assert len(got) == 400 and out.sweep.k == 2
    # Keys stay with their rows: the parity that made a row decides its cluster.
    assert len({(int(r["id"][1:]) % 2, r["prediction"]) for r in got}) == 2
    assert all(abs(r["raw_features"][0] - r["x"]) < 1e-12 for r in got)
    m = flows.yearly_measures(out.rows, out.reduction.components)
    assert m.count() == 5 and m.filter("between_year IS NULL").count() == 1
    years = flows.tracks_to_clusters(df, ["x", "y", "z"], "day", "1921-01-01", "2020-12-31", 0.9, [2], min_cluster=1, first_year=2002)
    assert years.rows.agg(F.min("year")).first()[0] == 2002


def test_lists_to_rules(spark):
    df = spark.createDataFrame([("['a', 'b']",)] * 6 + [("['a']",)] * 2 + [("['b', 'c', 'c']",)] * 2 + [(None,)], "g string")
    out = flows.lists_to_rules(df, "g", 0.1, 0.5)
    assert {tuple(r["items"]): r["freq"] for r in out.itemsets.collect()}[("a", "b")] == 6
    assert out.edges.count() >= 2 and out.degrees.count() == 3


def test_counts_to_verified_forecast(spark):
    t0 = dt.datetime(2015, 1, 1)
    rows = []
    for i in range(24 * 800):
        v = 10.0 + 3.0 * np.sin(2 * np.pi * i / (24 * 7)) + (i % 24)
        rows.append((t0 + dt.timedelta(hours=i), float(v), None if i == 100 else 1.0))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, wb double, eb double").repartition(4)
    out = flows.counts_to_verified_forecast(df, "wb", "eb", "2015-01-01", "2017-02-28", 2017, Design(cycles=(("weekly", 7.0, 3),)))
    acc = {r["split"]: r for r in out.accuracy.collect()}
    assert acc["train"]["n"] == 731 and acc["test"]["n"] == 59 and acc["test"]["r"] > 0.9
    assert out.monthly.count() == 14 and out.residuals.count() == 2
