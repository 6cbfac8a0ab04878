import math

from pyspark.sql import functions as F

from trendlake.functions import dates, lists, terms, vectors


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_list_forms(spark):
    rows = [("['rock', 'pop']",), ("[\"children's music\", 'pop']",), ("[]",), (None,), ("['trap']",)]
    df = spark.createDataFrame(rows, "g string").select(
        lists.parse_list_strict("g").alias("strict"), lists.parse_list_plain("g").alias("plain"), lists.parse_list_json("g").alias("json"))
    strict, plain, json = zip(*[tuple(r) for r in df.collect()])
    assert strict[0] == plain[0] == json[0] == ["rock", "pop"]
    assert plain[1] == ["children's music", "pop"] and json[1] == ["children's music", "pop"]
    # The strict form needs quote-comma-quote between items and loses apostrophes.
    assert strict[1] == ["childrens music, pop"] or "'" not in "".join(strict[1])
    assert plain[2] == plain[3] == [] and json[2] == [] and json[3] is None and strict[3] is None


def test_dates(spark):
    rows = [("1999",), ("1999-05",), ("1999-05-07",), ("nope",), (None,)]
    df = spark.createDataFrame(rows, "d string").select(
        dates.parse_date("d").cast("string").alias("p"), dates.year_of("d").alias("y"), dates.year_prefix("d").alias("s"))
    got = [tuple(r) for r in df.collect()]
    assert got[:3] == [("1999-01-01", 1999, 1999), ("1999-05-01", 1999, 1999), ("1999-05-07", 1999, 1999)]
    assert got[3] == (None, None, None) and got[4] == (None, None, None)
    assert one(spark, dates.window_start(F.lit(1998), 5))[0] == 1995


def test_terms(spark):
    df = spark.createDataFrame([("1998-06-01",), ("1999-01-01",), ("2003-05-05",)], "d string").select(F.to_date("d").alias("ds"))
    got = [tuple(r) for r in df.select(terms.step_from("ds", 1999), terms.ramp_from("ds", 1999)).collect()]
    assert got == [(0.0, 0.0), (1.0, 0.0), (1.0, 4.0)]
    row = df.select(*terms.fourier_terms("ds", 365.25, 2, "y")).first()
    assert math.isclose(row["y_sin1"] ** 2 + row["y_cos1"] ** 2, 1.0)
    assert terms.bin_labels([0, 2, 100]) == [(0, 2, "0.0-2.0"), (2, 100, "2.0-100.0")]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 3.0]), (2, [None, 1.0]), (3, None)], "id int, s array<double>")
    kept = vectors.with_coordinates(df, ["id"], "s", 2).collect()
    assert [tuple(r) for r in kept] == [(1, 0.0, 3.0)]
    d = df.filter("id = 1").select(vectors.euclidean_arrays("s", F.array(F.lit(4.0), F.lit(0.0)))).first()[0]
    assert d == 5.0
