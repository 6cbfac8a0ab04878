"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the others run."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracle import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in ORACLE])
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, cur.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-5, rel=1e-6, nan_ok=True) if _numbers(a) else a == b


def _numbers(row):
    return all(v is None or isinstance(v, (int, float)) for v in row) and None not in row


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "year" and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
