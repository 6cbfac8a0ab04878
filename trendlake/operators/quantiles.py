"""Exact quantiles per group without holding a group in one task.

``percentile`` keeps every distinct value of a group in one buffer. Here the
wanted ranks are found digit by digit: the range of a group's values is cut
into ``BINS`` equal parts, one count for each part says in which part a rank
lies, and the range shrinks to the values of that part until it is a single
one. A round has at most ``BINS`` counts for a group and rank, whatever the
rows, and every range shrinks at least by its own ends. After the first round only
rows of the parts in question are read again. The answer is the
linear-interpolation quantile of the two neighbouring values, exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.session import materialise

BINS = 1 << 14


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which a null key meets a null key; the keys appear once."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(right, same, how).drop(*[f"_right_{k}" for k in keys])


def _part(v: Column, low: Column, high: Column, bins: int) -> Column:
    """The part of the range a value is in, rising with the value. Infinite values and NaN have parts of their own."""
    half, width = v * 0.5 - low * 0.5, high * 0.5 - low * 0.5  # halves, as the range itself may overflow
    inner = F.when(width > 0, F.least(F.floor(half / width * bins), F.lit(bins - 1))).otherwise((v > low).cast("long"))
    infinite = F.lit(float("inf"))
    return F.when(F.isnan(v), bins + 1).when(v == infinite, bins).when(v == -infinite, -1).otherwise(inner).cast("long")


def _finite(v: Column) -> Column:
    return F.when(F.abs(v) < float("inf"), v)


def _narrowed(rows: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """The parts that hold a wanted rank: keys, low, high, flow, fhigh, before, ranks.

    ``rows`` carry their bracket. A bracket has at most ``bins`` parts and a
    few more, so the running sums over them are short.
    """
    at = ["low", "high", "flow", "fhigh", "before", "ranks"]
    counted = rows.groupBy(*keys, *at, _part(F.col("value"), F.col("flow"), F.col("fhigh"), bins).alias("part")).agg(
        F.count(F.lit(1)).alias("c"), F.min("value").alias("l"), F.max("value").alias("h"),
        F.min(_finite(F.col("value"))).alias("fl"), F.max(_finite(F.col("value"))).alias("fh"),
    )
    upto = F.sum("c").over(Window.partitionBy(*keys, "low").orderBy("part"))
    ranked = counted.withColumn("upto", F.col("before") + upto)
    inside = F.filter("ranks", lambda r: (r > F.col("upto") - F.col("c")) & (r <= F.col("upto")))
    return ranked.select(
        *keys, F.col("l").alias("low"), F.col("h").alias("high"), F.col("fl").alias("flow"), F.col("fh").alias("fhigh"),
        (F.col("upto") - F.col("c")).alias("before"), inside.alias("ranks"),
    ).filter(F.size("ranks") > 0)


def group_quantiles(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: Sequence[float],
    extra: Sequence[Column] = (), accuracy: int | None = None,
) -> DataFrame:
    """``by``, ``metric``, ``n`` and array ``q`` (one entry per probability), missing values ignored.

    NaN counts as larger than every number. ``extra`` are further aggregates
    of ``value``, computed in the first pass. ``accuracy`` is the number of
    parts of a range (``BINS`` if none is given); the answer does not depend on it.
    """
    bins = max(accuracy or BINS, 2)
    by = list(by)
    keys = [*by, "metric"]
    long = (
        df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(by, list(columns), "metric", "value")
        .filter(F.col("value").isNotNull())
    )
    n = F.col("n")
    wanted = [(F.floor(F.lit(float(p)) * (n - 1)) + 1, F.ceil(F.lit(float(p)) * (n - 1)) + 1) for p in probs]
    stats = materialise(long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min(_finite(F.col("value"))).alias("flow"), F.max(_finite(F.col("value"))).alias("fhigh"), *extra,
    ))
    whole = stats.select(
        *keys, "low", "high", "flow", "fhigh", F.lit(0).cast("long").alias("before"),
        F.array_distinct(F.array(*[r for pair in wanted for r in pair])).alias("ranks"),
    )
    single = F.col("low") == F.col("high")
    found = [whole.filter(single)]
    state = whole.filter(~single)
    rows = null_safe_join(long, state, keys)
    for turn in range(1_100):  # far beyond what the digits of a double allow
        parts = materialise(_narrowed(rows, keys, bins))
        found.append(parts.filter(single))
        state = parts.filter(~single)
        if state.isEmpty():
            break
        rest = null_safe_join(rows.select(*keys, "value") if turn else long, state, keys)
        rows = materialise(rest.filter((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))))
    values = reduce(DataFrame.unionByName, found).select(*keys, F.explode("ranks").alias("r"), F.col("low").alias("v"))
    per_group = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at"))
    out = null_safe_join(stats.drop("low", "high", "flow", "fhigh"), per_group, keys)

    def quantile(p: float, r0: Column, r1: Column) -> Column:
        v0, v1 = F.element_at("at", r0), F.element_at("at", r1)
        share = F.lit(float(p)) * (n - 1) - (r0 - 1)
        return F.when(r0 == r1, v0).otherwise(v0 + share * (v1 - v0))

    q = F.array(*[quantile(p, r0, r1) for p, (r0, r1) in zip(probs, wanted)]).alias("q")
    return out.select(*keys, "n", *[c for c in stats.columns if c not in (*keys, "n", "low", "high", "flow", "fhigh")], q)
