from pyspark.sql import functions as F
import pytest

from trendlake.functions.dates import undated_rows
from trendlake.operators import smooth, trends
from trendlake.session import shared_folder


def test_every_year_is_kept_and_null_years_are_counted(spark):
    rows = [(i, y, float(i % 3), float(i % 5)) for i, y in enumerate([0, 0, 1999, 1999, 2023, 2023, 12000, 12000, None])]
    df = spark.createDataFrame(rows, "id int, year int, a double, b double")
    assert {r["year"] for r in trends.yearly_dispersion(df, ["a", "b"]).collect()} == {0, 1999, 2023, 12000}
    levels = trends.innovation_levels(df, ["a", "b"], [0, 100]).collect()
    assert sum(r["0.0-100.0"] for r in levels) == 8
    assert undated_rows(df).first().asDict() == {"rows": 9, "undated": 1}


def test_loess_takes_floor_of_span_times_n(spark):
    # 5 points, span 0.75: 3 neighbours. At x = 0 the reach is 2, weights 1, (1 - 1/8)^3 and 0, so the fit is the line
    # through the first two points, which gives the first y back.
    df = spark.createDataFrame([("g", x, float(y)) for x, y in enumerate([1, 3, 2, 8, 4])], "g string, year int, mean_val double")
    got = {r["year"]: r["smooth"] for r in smooth.loess(df, ["g"]).collect()}
    assert got[0] == pytest.approx(1.0)
    # At x = 2 the neighbours are 1, 2 and 3 at reach 1: only the point itself has weight.
    assert got[2] == pytest.approx(2.0)


def test_cluster_sessions_must_name_the_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_undated_rows_of_an_expression(spark):
    df = spark.range(4).select(F.when(F.col("id") > 0, F.col("id")).alias("y"))
    assert undated_rows(df, "y").first()["undated"] == 1
