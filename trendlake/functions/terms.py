"""Design terms and small statistics used by trend tables and regressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def standard_error(c: str | Column) -> Column:
    """Sample deviation over the root of the count."""
    return F.stddev_samp(_col(c)) / F.sqrt(F.count(_col(c)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)


def bin_label(low: float, high: float) -> str:
    return f"{low:.1f}-{high:.1f}"


def bin_labels(edges: Sequence[float]) -> list[tuple[float, float, str]]:
    return [(lo, hi, bin_label(lo, hi)) for lo, hi in zip(edges, edges[1:])]


def step_from(ds: str | Column, event_year: int) -> Column:
    """0 before 1 January of the event year, 1 from then on."""
    return F.when(F.year(_col(ds)) >= event_year, 1.0).otherwise(0.0)


def ramp_from(ds: str | Column, event_year: int) -> Column:
    """Years since the event year, 0 before it."""
    return F.greatest(F.year(_col(ds)) - F.lit(event_year), F.lit(0)).cast("double")


def days_since_epoch(ds: str | Column) -> Column:
    return F.datediff(_col(ds).cast("date"), F.lit("1970-01-01").cast("date")).cast("double")


def fourier_terms(ds: str | Column, period_days: float, order: int, name: str) -> list[Column]:
    """sin and cos columns ``{name}_sin1, {name}_cos1, ...`` of one period."""
    t = days_since_epoch(ds)
    out = []
    for k in range(1, order + 1):
        angle = t * F.lit(2.0 * math.pi * k / period_days)
        out += [F.sin(angle).alias(f"{name}_sin{k}"), F.cos(angle).alias(f"{name}_cos{k}")]
    return out
