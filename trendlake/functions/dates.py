"""Date parts and partial dates that survive ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: str | Column) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD``; missing parts become 01, anything else null."""
    return F.try_to_date(_col(c))


def year_of(c: str | Column) -> Column:
    return F.year(parse_date(c)).cast("int")


def year_prefix(c: str | Column) -> Column:
    """First four characters as a number, null when they are not one."""
    return F.substring(_col(c).cast("string"), 1, 4).try_cast("int")


def window_start(year: str | Column, width: int) -> Column:
    """First year of the ``width``-year window a year belongs to."""
    return (F.floor(_col(year) / F.lit(width)) * width).cast("int")


def date_parts(ts: str | Column, prefix: str = "") -> list[Column]:
    """year, month, dayofyear, weekday (Monday 0), hour and weekday name."""
    c = _col(ts)
    return [
        F.year(c).cast("int").alias(f"{prefix}year"),
        F.month(c).cast("int").alias(f"{prefix}month"),
        F.dayofyear(c).cast("int").alias(f"{prefix}dayofyear"),
        F.weekday(c).cast("int").alias(f"{prefix}weekday"),
        F.hour(c).cast("int").alias(f"{prefix}hour"),
        F.date_format(c, "EEEE").alias(f"{prefix}weekday_name"),
    ]


def dated(year: str | Column) -> Column:
    """Rows that belong to some year, whatever its number; ``undated_rows`` counts the others."""
    return _col(year).isNotNull()


def undated_rows(df: DataFrame, year: str | Column = "year") -> DataFrame:
    """``rows, undated``: how many rows there are and how many of them the yearly tables leave out."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(_col(year).isNull()).alias("undated"))
