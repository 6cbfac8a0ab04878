"""Score vectors as plain numeric columns.

Operators accept a score either as an array column with a known number of
dimensions or as a list of numeric columns. Both become one expression per
dimension, so sums and distances stay inside generated code and need neither
an action to learn the size nor a Python function.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "array_to_vector", "vector_to_array", "feature_array", "coordinates",
    "coordinate_names", "with_coordinates", "euclidean", "euclidean_arrays",
]


def feature_array(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _coordinate_sql(score: str | Sequence[str], dims: int | None) -> list[str]:
    if isinstance(score, str):
        if not dims:
            raise ValueError("an array score needs dims")
        return [f"CAST(get({_quoted(score)}, {i}) AS DOUBLE)" for i in range(dims)]
    return [f"CAST({_quoted(c)} AS DOUBLE)" for c in list(score)[: dims or len(score)]]


def dimension(score: str | Sequence[str], dims: int | None = None) -> int:
    return len(_coordinate_sql(score, dims))


def coordinates(score: str | Sequence[str], dims: int | None = None) -> list[Column]:
    """One double expression per dimension."""
    return [F.expr(x) for x in _coordinate_sql(score, dims)]


def coordinate_names(score: str | Sequence[str], dims: int | None = None, prefix: str = "x") -> list[str]:
    return [f"{prefix}{i}" for i in range(dimension(score, dims))]


def with_coordinates(
    df: DataFrame, keep: Sequence[str], score: str | Sequence[str], dims: int | None = None
) -> DataFrame:
    """``keep`` columns plus x0..x{d-1}; rows with a missing coordinate are left out."""
    xs = _coordinate_sql(score, dims)
    # One condition per coordinate: a single condition over all of them makes
    # the optimiser try every mix of column and alias.
    present = df.filter(" AND ".join(f"{x} IS NOT NULL" for x in xs))
    return present.select(*keep, *[F.expr(f"{x} AS x{i}") for i, x in enumerate(xs)])


def euclidean(dims: int, a: str = "x", b: str = "c") -> Column:
    """Distance of the points in columns ``a0..`` and ``b0..``."""
    return F.expr("sqrt(" + " + ".join(f"({a}{i} - {b}{i}) * ({a}{i} - {b}{i})" for i in range(dims)) + ")")


def euclidean_arrays(a: str | Column, b: str | Column) -> Column:
    """Distance of two array columns of any, even unknown, length."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    squares = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))
