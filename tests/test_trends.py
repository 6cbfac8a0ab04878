import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlake.operators import trends as T

XS = ["u", "v", "w"]


def frame(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


OPERATORS = {
    "dispersion": lambda df: T.yearly_dispersion(df, XS),
    "within": lambda df: T.within_artist_dispersion(df, XS, min_songs=2),
    "between": lambda df: T.between_artist_dispersion(df, XS),
    "pairwise": lambda df: T.between_artist_pairwise(df, XS, block_rows=4),
    "history": lambda df: T.artist_history_distance(df, XS),
    "innovation": lambda df: T.yearly_innovation(df, XS),
    "levels": lambda df: T.innovation_levels(df, XS, [0, 1, 2, 100], "historical"),
    "trends": lambda df: T.feature_trends(df, XS),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_layout_does_not_matter(points, name):
    one = frame(OPERATORS[name](points.repartition(1)))
    eight = frame(OPERATORS[name](points.repartition(8)))
    assert len(one) == len(eight) > 0
    for a, b in zip(one, eight):
        assert [x for x in a if x is None] == [x for x in b if x is None]
        assert [x for x in a if isinstance(x, (int, float))] == pytest.approx([x for x in b if isinstance(x, (int, float))])


def table(points):
    rows = points.collect()
    return np.array([r["year"] for r in rows]), np.array([r["artist"] for r in rows]), np.array([[r[c] for c in XS] for r in rows])


def test_pairwise_equals_all_pairs(points):
    year, artist, x = table(points)
    got = {r["year"]: (r["avg_distance"], r["pair_count"]) for r in T.between_artist_pairwise(points, XS, block_rows=3).collect()}
    for y in np.unique(year):
        centres = [x[(year == y) & (artist == a)].mean(axis=0) for a in np.unique(artist[year == y])]
        d = [np.linalg.norm(a - b) for a, b in itertools.combinations(centres, 2)]
        assert got[y][1] == len(d) and got[y][0] == pytest.approx(np.mean(d))


def test_history_uses_only_the_same_artists_past(points):
    year, artist, x = table(points)
    got = {r["year"]: (r["avg_distance"], r["song_count"]) for r in T.artist_history_distance(points, XS).collect()}
    for y in np.unique(year):
        d = []
        for a in np.unique(artist):
            past, now = x[(artist == a) & (year < y)], x[(artist == a) & (year == y)]
            if len(past):
                d += list(np.linalg.norm(now - past.mean(axis=0), axis=1))
        assert (y not in got) if not d else (got[y][1] == len(d) and got[y][0] == pytest.approx(np.mean(d)))


def test_historical_centre_starts_empty(points):
    rows = {r["year"]: r for r in T.yearly_innovation(points, XS).collect()}
    assert rows[2000]["between_year"] is None and rows[2001]["between_year"] > 0
    levels = {r["year"]: r for r in T.innovation_levels(points, XS, [0, 100], "historical").collect()}
    assert levels[2000]["0.0-100.0"] == 0
    assert levels[2001]["0.0-100.0"] == points.filter("year = 2001").count()


def test_bins_are_half_open(spark):
    df = spark.createDataFrame([(2000, -1.0, 0.0), (2000, 1.0, 0.0)], "year int, a double, b double")
    got = T.innovation_levels(df, ["a", "b"], [0, 1, 2]).first()
    assert (got["0.0-1.0"], got["1.0-2.0"]) == (0, 2)


def test_array_and_column_scores_agree(points):
    packed = points.withColumn("score", F.array(*XS))
    for a, b in zip(frame(T.yearly_dispersion(points, XS)), frame(T.yearly_dispersion(packed, "score", 3)), strict=True):
        assert a == pytest.approx(b)


def test_only_null_years_are_left_out(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (20000, 1.0, 1.0), (1999, 1.0, 1.0)], "year int, a double, b double")
    assert [r["year"] for r in T.yearly_centre(df, ["a", "b"]).orderBy("year").collect()] == [1999, 20000]
