"""List-like text to arrays, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_list_strict(c: str | Column) -> Column:
    """``['a', 'b']`` -> array: brackets and double quotes go, split on ``', '``, apostrophes go."""
    bare = F.regexp_replace(_col(c), r'[\[\]"]', "")
    parts = F.split(bare, r"', '")
    return F.transform(parts, lambda p: F.regexp_replace(p, "'", ""))


def parse_list_plain(c: str | Column) -> Column:
    """Split on every comma, trim blanks then quotes; ``[]`` and null give an empty array."""
    bare = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"^[\[\]]+|[\[\]]+$", "")
    parts = F.transform(
        F.split(bare, ","),
        lambda p: F.regexp_replace(F.trim(p), r"""^['"]+|['"]+$""", ""),
    )
    return F.filter(parts, lambda p: p != "")


def parse_list_json(c: str | Column) -> Column:
    """JSON reading of the literal (single quotes are accepted); keeps commas inside names."""
    return F.from_json(_col(c), "array<string>")


def item_label(c: str | Column) -> Column:
    """Readable label of an item set."""
    return F.array_join(_col(c), " , ")
