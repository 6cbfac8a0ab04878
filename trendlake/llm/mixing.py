"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output divided by
its share of the input. Each document draws its number of copies by inverting
a Poisson distribution with that mean at a uniform number hashed from its id
and a seed (without an id: from all its columns and the seed), is repeated so often, and all copies are put in a global order by
hash. Everything is a column expression; only the table with one row per
source is aggregated.

The draw depends on the id, the seed and the source's rate alone, so a lost
task draws the same again. Rows without an id have the md5 of all their
columns, text included, in its place, for the draw and for the order. Null sources form the source "" with its own
weight; null texts count as size 0; sources of size 0 keep rate 1. Repeated
rows draw the same number each. Extra columns stay, but the names copy and
shuffle_key are taken. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.llm.tables import empty_if_null, unused, written

SEED = 17
#: A Poisson mean above this is drawn as a sum of equal smaller ones (exp stays far from zero).
CHUNK = 64.0


def uniform(key: Column, *salts: Column | str | int) -> Column:
    """A number in [0, 1) from 52 bits of md5 over the key and salts."""
    parts = [F.coalesce(key.cast("string"), F.lit("")), *[s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in salts]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def poisson(mean: Column, draw: Column) -> Column:
    """The least k whose cumulative Poisson probability exceeds ``draw``."""
    most = F.ceil(mean + 12.0 * F.sqrt(mean) + 25.0).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.when(draw >= s["c"], F.struct(p.alias("p"), (s["c"] + p).alias("c"), i.alias("k"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])


def copies(key: Column, rate: Column, seed: int) -> Column:
    """Copies of a row: the sum of Poisson draws whose means sum to ``rate``."""
    parts = F.greatest(F.ceil(rate / CHUNK), F.lit(1)).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), parts), F.lit(0),
        lambda n, j: n + poisson(rate / parts, uniform(key, seed, j)),
    )


def own_key(df: DataFrame, id_col: str) -> Column:
    """The md5 of all columns of a row without an id, null for others."""
    return F.when(F.col(id_col).isNull(), F.md5(F.to_json(F.struct(*df.columns)).cast("binary")))


def rates_by_size(sizes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``source, rate`` from ``source, size`` and target ``source, weight``; the total size is kept.

    Without weights the target share of a source is proportional to the
    square root of its size. Sources without a weight get rate 0.
    """
    sized = sizes if weights is None else sizes.join(weights, "source", "left")
    sized = sized.select("source", "size", (F.sqrt("size") if weights is None else F.coalesce(F.col("weight").cast("double"), F.lit(0.0))).alias("w"))
    total = sized.agg(F.struct(F.sum("size").alias("size"), F.sum("w").alias("w")).alias("t")).scalar()
    t = F.col("t")
    return sized.withColumn("t", total).select(
        "source",
        F.when(F.col("size") > 0, F.col("w") / t["w"] * t["size"] / F.col("size")).otherwise(F.lit(1.0)).alias("rate"),
    )


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
    weights: DataFrame | None = None, seed: int = SEED, shuffle: bool = True,
) -> DataFrame:
    """``df`` replicated to the target weights, with ``copy`` (from 1) and ``shuffle_key``, in order of the key.

    Sizes are code points of text. ``weights`` has ``source, weight``. Columns
    of ``df`` named ``copy`` or ``shuffle_key`` are replaced, all others kept.
    """
    df = df.drop("copy", "shuffle_key")
    own, origin, rate, count = (unused(c, df.columns) for c in ("_own", "_source", "_rate", "_count"))
    sizes = written(
        df.groupBy(empty_if_null(source).alias("source")).agg(F.sum(F.length(empty_if_null(text))).cast("double").alias("size"))
    )
    rates = written(rates_by_size(sizes, weights)).select(F.col("source").alias(origin), F.col("rate").alias(rate))
    drawn = (
        df.withColumns({own: own_key(df, id_col), origin: empty_if_null(source)}).join(rates, origin)
        .withColumn(count, copies(F.coalesce(F.col(id_col).cast("string"), F.col(own)), F.col(rate), seed)).filter(F.col(count) > 0)
        .select(*df.columns, own, F.explode(F.sequence(F.lit(1), F.col(count))).alias("copy"))
        .withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col(id_col), F.col(own), F.col("copy")))  # nulls add nothing
    )
    return (drawn.sort("shuffle_key", F.col(id_col), own, "copy") if shuffle else drawn).drop(own)
