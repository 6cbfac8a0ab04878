import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trendlake.operators import clean, profile, shares
from trendlake.operators.quantiles import group_quantiles
from trendlake.plans.flows import raw_tracks
from trendlake.sources.files import TRACK_RAW_COLUMNS, hash_sample, hash_split, read_csv, write_csv


@pytest.fixture
def track_csv(spark, tmp_path):
    base = {c: "0.5" for c in TRACK_RAW_COLUMNS} | {c: "1" for c in clean.TRACK_INT} | {"explicit": "True"}
    rows = []
    for i, (artists, day, energy) in enumerate([
        ("['A']", "1999", "0.1"), ("['A', 'B']", "1999-05", "0.2"), ("[\"O'X\"]", "1999-05-07", "0.3"),
        ("[]", "1999-01-01", "0.4"), ("['C']", "invalid", "0.5"), ("['D']", None, "n/a"), ("['E, F']", "2001-02-03", None),
    ]):
        rows.append(base | {"id": f"t{i}", "name": f"n{i}", "artists": artists, "release_date": day, "energy": energy, "loudness": "-5.3"})
    df = spark.createDataFrame([tuple(r[c] for c in TRACK_RAW_COLUMNS) for r in rows], ", ".join(f"`{c}` string" for c in TRACK_RAW_COLUMNS))
    path = str(tmp_path / "tracks")
    write_csv(df, path)
    return path


def test_raw_tracks(spark, track_csv):
    rows = {(r["id"], r["artist"]): r for r in raw_tracks(spark, track_csv).collect()}
    assert set(k for k in rows) == {
        ("t0", "A"), ("t1", "A"), ("t1", "B"), ("t2", "O'X"), ("t3", None), ("t4", "C"), ("t5", "D"), ("t6", "E, F")}
    assert str(rows["t1", "B"]["release_date"]) == "1999-05-01" and rows["t4", "C"]["release_date"] is None
    assert rows["t5", "D"]["energy"] is None and rows["t0", "A"]["loudness"] == -5.3 and rows["t0", "A"]["explicit"] is True


def test_funnel_and_shares(spark, track_csv):
    raw = read_csv(spark, track_csv, TRACK_RAW_COLUMNS)
    assert profile.year_only_share(raw, "release_date").first()["matching"] == 1
    assert profile.placeholder_date_share(raw, "release_date").first()["matching"] == 2
    f = profile.row_funnel(raw.select("id", "release_date", "energy"), "release_date", "1999-01-02", "2020-12-31").first()
    assert tuple(f) == (7, 5, 2)
    nulls = {r["column_name"]: r["nulls"] for r in profile.null_counts(raw.select("release_date", "energy")).collect()}
    assert nulls == {"release_date": 1, "energy": 1}


def test_text_range_drops_bare_year(spark):
    df = spark.createDataFrame([("1921",), ("1921-01-01",), ("2020-12-31",)], "d string")
    assert clean.date_range(df, "d", "1921-01-01", "2020-12-31", as_text=True).count() == 2
    assert clean.date_range(df, "d", "1921-01-01", "2020-12-31").count() == 3


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [1.0, 2.0, 4.0, 9.0], [3.0] * 50, [0.0, -1.0, None, 7.5, 7.5, None, 2.0],
    list(np.random.default_rng(1).lognormal(size=5000)), [1.0] * 3000 + list(np.random.default_rng(2).normal(size=1500)),
])
@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_are_exact(spark, values, accuracy):
    df = spark.createDataFrame([("g", float(v) if v is not None else None) for v in values], "g string, v double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    want = np.quantile([v for v in values if v is not None], probs)
    for by in ([], ["g"]):
        row = group_quantiles(df, by, ["v"], probs, accuracy=accuracy).first()
        assert row["q"] == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_quantiles_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r["g"]: r["q"] for r in group_quantiles(df, ["g"], ["v"], [0.5]).collect()}
    assert got == {None: [2.0], "a": [5.0]}


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"g": ["a", "b"] * 500, "v": np.random.default_rng(3).normal(size=1000)})
    df = spark.createDataFrame(pdf)
    want = pdf.groupby("g")["v"].describe()
    for r in profile.describe(df, ["v"], ["g"]).collect():
        w = want.loc[r["g"]]
        assert [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]] == pytest.approx(list(w))


def test_outliers_sequential_differs_from_one_pass(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": np.r_[rng.normal(size=300), [50.0] * 20], "b": np.r_[rng.normal(size=300), [9.0] * 10, [0.0] * 10]})
    df = spark.createDataFrame(pdf)
    want = pdf
    for c in ("a", "b"):
        q1, q3 = want[c].quantile([0.25, 0.75])
        want = want[want[c].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
    assert clean.remove_outliers(df, ["a", "b"]).count() == len(want)
    keep = np.ones(len(pdf), bool)
    for c in ("a", "b"):
        q1, q3 = pdf[c].quantile([0.25, 0.75])
        keep &= pdf[c].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)).to_numpy()
    assert clean.remove_outliers(df, ["a", "b"], sequential=False).count() == keep.sum()


def test_imputation_and_scaling(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("4",)], "v string")
    assert sorted(r["v"] for r in clean.impute_mean(df, ["v"]).collect()) == [1.0, 2.5, 2.5, 4.0]
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "c double, v double")
    z = clean.zscore(flat, ["c", "v"]).collect()
    assert [r["c"] for r in z] == [None, None] and sorted(r["v"] for r in z) == pytest.approx([-(0.5**0.5), 0.5**0.5])
    assert sorted(r["v"] for r in clean.minmax(flat, ["v"]).collect()) == [0.0, 1.0]
    clipped = clean.clip_lower(spark.createDataFrame([(-1.0,), (None,), (2.0,)], "v double"), ["v"])
    assert [r["v"] for r in clipped.collect()] == [0.0, None, 2.0]


def test_keyword_overlap(spark):
    df = spark.createDataFrame([("['trap']",), ("[]",), ("['rock', 'rap']",), ("['jazz']",)], "g string")
    got = {r["bucket"]: r["count"] for r in shares.keyword_shares(df, "g", ["rap", "rock"]).collect()}
    assert got == {"empty": 1, "rap": 2, "rock": 1, "others": 1}


def test_hash_sampling_ignores_layout(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r["k"] for r in hash_sample(df.repartition(1), ["k"], 0.2, 3).collect()}
    b = {r["k"] for r in hash_sample(df.repartition(8), ["k"], 0.2, 3).collect()}
    assert a == b and 800 < len(a) < 1200
    left, right = hash_split(df, ["k"], 0.5, 3)
    assert left.count() + right.count() == 5000 and left.join(right, "k").count() == 0


def test_shares_sum_to_one(spark, points):
    s = shares.cluster_share(points.withColumn("prediction", F.col("id") % 5), "year")
    assert all(abs(r["t"] - 1.0) < 1e-12 for r in s.groupBy("year").agg(F.sum("share").alias("t")).collect())


def test_numbering_is_consecutive(spark):
    from trendlake.operators.joins import number_rows

    df = spark.createDataFrame([(f"k{i:04d}",) for i in range(3000)], "k string").repartition(7)
    got = [(r["k"], r["number"]) for r in number_rows(df, "k").orderBy("k").collect()]
    assert got == [(f"k{i:04d}", i) for i in range(3000)]
