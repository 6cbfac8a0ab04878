"""Euclidean minimum spanning trees in the plane, of all places or per group.

The rows' ranks in x and in y, bit by bit in turn, place every location in a
tree of boxes whose depth is the logarithm of the rows, however uneven the
data are. The largest boxes of at most ``BLOCK`` places are blocks: an edge of
the spanning tree within a block is one of the block's own tree, which one
task finds by itself.

An edge between blocks joins a place to the nearest one in one of the eight
directions around it, as two places of a direction are nearer to each other
than the farther one is to its centre (Yao). Only the directions in which a
block's own nearest place is farther than its edge are asked of other blocks,
down the tree of boxes and by bounds. That leaves few candidate edges a
location, of which rounds of Borůvka's method choose the tree: every part takes
its shortest edge.

Rounds are joins and aggregates over written tables. A join meets a box with
its four parts at most; no more rows than a block are ever gathered.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.operators.joins import number_rows
from trendlake.session import materialise

_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
#: Places of a block: their tree takes one task this number squared of steps.
BLOCK = 512


def _spread_bits(value: Column) -> Column:
    """The low 31 bits of a number, each with an empty bit before it."""
    for shift, mask in _SPREAD:
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return value


def prim(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's method from row 0: every further row as it joins, the row it joins and their squared distance."""
    n = max(len(x) - 1, 0)
    rows, by, w = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n)
    out, near, best = np.arange(1, n + 1), np.zeros(n, np.int64), np.full(n, np.inf)
    ox, oy = x[1:].astype(float), y[1:].astype(float)
    at = 0
    with np.errstate(over="ignore"):
        for step in range(n):
            left = n - step
            dx, dy = ox[:left] - x[at], oy[:left] - y[at]
            far = dx * dx + dy * dy
            closer = far <= best[:left]
            near[:left][closer] = at
            best[:left][closer] = far[closer]
            k = int(best[:left].argmin())
            at = rows[step] = out[k]
            by[step], w[step] = near[k], best[k]
            for column in (out, near, best, ox, oy):
                column[k] = column[left - 1]
    return rows, by, w


def _directions(dx, dy):
    """The direction of a difference, 0 to 7: the signs, and whether it is steep. Columns and arrays alike."""
    steep = abs(dy) > abs(dx) if isinstance(dx, np.ndarray) else F.abs(dy) > F.abs(dx)
    signs = (dx >= 0, dy >= 0, steep)
    east, north, steep = [s.astype(int) if isinstance(s, np.ndarray) else s.cast("int") for s in signs]
    return east * 4 + north * 2 + steep


def _block_answers(places: DataFrame, tasks: int) -> DataFrame:
    """``a, b, w`` of every block's tree; with null ``b``, a place's direction ``k`` in which other blocks may have a place nearer than ``w``."""

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        ids, x, y = (frame[c].to_numpy() for c in ("id", "x", "y"))
        rows, by, w = prim(x, y)
        a, b = ids[rows], ids[by]
        tree = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "k": 0, "w": w, "x": 0.0, "y": 0.0})
        parts = [tree.astype({"b": "Int64"})]
        with np.errstate(over="ignore"):
            dx, dy = x[None, :] - x[:, None], y[None, :] - y[:, None]
            far, way = dx * dx + dy * dy, _directions(dx, dy)
            np.fill_diagonal(way, -1)
            for k in range(8):
                w = np.where(way == k, far, np.inf).min(axis=1)
                # a hair more, as the root is rounded
                reach = np.sqrt(w) * (1 + 1e-9)
                east = x + reach >= x.max() if k & 4 else x - reach <= x.min()
                north = y + reach >= y.max() if k & 2 else y - reach <= y.min()
                ask = np.flatnonzero(east | north)
                parts.append(pd.DataFrame({"a": ids[ask], "b": pd.array([None] * len(ask), dtype="Int64"), "k": k, "w": w[ask], "x": x[ask], "y": y[ask]}))
        out = pd.concat(parts, ignore_index=True)
        return out.assign(grp=frame["grp"].iloc[0], block=frame["block"].iloc[0])

    shape = "a long, b long, k int, w double, x double, y double, grp long, block long"
    # few bytes, much work: not to be put together into one task
    return places.select("grp", "block", "id", "x", "y").repartition(tasks, "block").groupBy("block").applyInPandas(answer, shape)


def _blocked(coded: DataFrame, bits: int, size: int) -> DataFrame:
    """Adds ``block``, the smallest id of the largest box with at most ``size`` places that holds the place, and the box: ``turn, path``."""
    found, at = [], ["grp", "turn", "path"]
    left = coded.withColumn("turn", F.lit(0))
    while True:
        left = left.withColumn("path", F.expr(f"shiftright(code, {bits} - 2 * turn)"))
        sizes = materialise(left.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("block")))
        left = left.join(sizes, at)
        found.append(left.filter(F.col("n") <= size).select(*coded.columns, "block", "turn", "path"))
        if sizes.filter(F.col("n") > size).isEmpty():
            return reduce(DataFrame.unionByName, found)
        deeper = F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / size) / 2)).cast("int")
        left = materialise(left.filter(F.col("n") > size).select(*coded.columns, F.least(F.col("turn") + deeper, F.lit(bits // 2)).alias("turn")))


def _boxes(coded: DataFrame) -> DataFrame:
    """The boxes down to the blocks: bounds and one place; ``leaf`` is the block, null for a box of several."""
    bounds = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    blocks = coded.groupBy("grp", "turn", "path", "block").agg(*bounds, F.min(F.struct("id", "x", "y")).alias("one"))
    above = materialise(blocks).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("turn"))))
    path = F.expr("shiftright(path, 2 * (turn - at))")
    return above.groupBy("grp", "at", path.alias("box")).agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
        F.min("one").alias("one"), F.max(F.when(F.col("turn") == F.col("at"), F.col("block"))).alias("leaf"),
    )


def _asked(asks: DataFrame, boxes: DataFrame, turns: int) -> DataFrame:
    """``a, k, x, y, w, block``: the other blocks that may have a place nearer than ``w`` in direction ``k``."""
    east, north, steep = [F.col("k").bitwiseAND(bit) > 0 for bit in (4, 2, 1)]

    def side(forward: Column, axis: str) -> tuple[Column, Column]:
        """The least and largest distance along an axis in its direction; the largest is negative if there is none."""
        low, high = F.col(f"{axis}0") - F.col(axis), F.col(f"{axis}1") - F.col(axis)
        return F.greatest(F.lit(0.0), F.when(forward, low).otherwise(-high)), F.when(forward, high).otherwise(-low)

    (x_least, x_most), (y_least, y_most) = side(east, "x"), side(north, "y")
    meets = (x_most >= 0) & (y_most >= 0) & F.when(steep, y_most >= x_least).otherwise(x_most >= y_least)
    dx, dy = F.col("one.x") - F.col("x"), F.col("one.y") - F.col("y")
    surely = (_directions(dx, dy) == F.col("k")) & (F.col("one.id") != F.col("a"))
    own = ["grp", "home", "a", "k", "x", "y", "w"]
    left = asks.withColumn("up", F.lit(0).cast("long"))
    found = []
    for turn in range(1, turns + 1):
        parts = boxes.filter(F.col("at") == turn).drop("at").withColumn("up", F.shiftright("box", 2))
        met = left.join(parts, ["grp", "up"]).filter(meets & (F.col("leaf").isNull() | (F.col("leaf") != F.col("home"))))
        met = met.withColumns({"least": _square(x_least, y_least), "reached": F.when(surely, _square(dx, dy))}).filter("least <= w")
        bound = F.least("w", F.min("reached").over(Window.partitionBy("a", "k")))
        met = materialise(met.select(*own, "box", "leaf", "least", bound.alias("bound")).filter("least <= bound").withColumn("w", F.col("bound")))
        found.append(met.filter("leaf is not null").select("a", "k", "x", "y", "w", F.col("leaf").alias("block")))
        left = met.filter("leaf is null").select(*own, F.col("box").alias("up"))
    return reduce(DataFrame.unionByName, found)


def _square(x: Column, y: Column) -> Column:
    return x * x + y * y


def candidate_edges(places: DataFrame, block: int | None = None) -> DataFrame:
    """``a, b, w``: place ids and squared lengths, with every edge of a minimum spanning tree among them.

    ``places`` has ``grp, id, x, y``; ids are unique and places differ within a
    group. A spanning tree is connected, so groups never share an edge. Blocks
    have at most ``block`` places (``BLOCK`` if none is given).
    """
    by_x = number_rows(places.withColumn("_x", F.struct("x", "y", "id")), "_x", "i").drop("_x")
    ranked = materialise(number_rows(by_x.withColumn("_y", F.struct("y", "x", "id")), "_y", "j").drop("_y"))
    rows = ranked.count()
    if rows > 1 << 30:
        raise ValueError("more places than fit in 30 bits")
    bits = 2 * max(1, (rows - 1).bit_length())
    coded = ranked.withColumn("code", F.shiftleft(_spread_bits(F.col("i")), 1).bitwiseOR(_spread_bits(F.col("j"))))
    coded = materialise(_blocked(coded, bits, max(block or BLOCK, 1)))
    answers = materialise(_block_answers(coded, 1 + rows // (16 * BLOCK)))
    trees = answers.filter("b is not null").select("a", "b", "w")
    turns = coded.agg(F.max("turn")).first()[0]
    if not turns:
        return trees
    # Groups of one block have no edge between blocks.
    asks = answers.filter("b is null").drop("b").withColumnRenamed("block", "home")
    asked = materialise(_asked(asks, materialise(_boxes(coded)), turns))
    there = coded.select("block", F.col("id").alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    near = asked.join(there, "block").withColumn("far", _square(dx, dy)).filter((F.col("far") <= F.col("w")) & (_directions(dx, dy) == F.col("k")))
    nearest = near.groupBy("a", "k").agg(F.min(F.struct("far", "b")).alias("e"))
    edges = nearest.select(F.least("a", "e.b").alias("a"), F.greatest("a", "e.b").alias("b"), F.col("e.far").alias("w"))
    return trees.unionByName(edges.distinct())


def lightest_tree(edges: DataFrame) -> DataFrame:
    """Borůvka's method: the edges ``a, b, w`` of a minimum spanning forest; equal weights are told apart by ``a, b``."""
    left = materialise(edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    chosen = []
    while not left.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("o")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("o"))))
        picks = materialise(
            left.select("a", "b", "w", ends.alias("s")).groupBy(F.col("s.c").alias("c"))
            .agg(F.min(F.struct("w", "a", "b", F.col("s.o").alias("o"))).alias("p")).select("c", "p.*")
        )
        chosen.append(picks.select("a", "b", "w"))
        other = picks.select(F.col("c").alias("o"), F.col("a").alias("oa"), F.col("b").alias("ob"))
        # two parts that choose one edge would point at each other: the smaller one becomes the root
        root = (F.col("a") == F.col("oa")) & (F.col("b") == F.col("ob")) & (F.col("c") < F.col("o"))
        to = materialise(picks.join(other, "o").select("c", F.when(root, F.col("c")).otherwise(F.col("o")).alias("t")))
        while True:
            moved = materialise(to.toDF("c", "before").join(to.toDF("before", "t"), "before"))
            to = moved.select("c", "t")
            if moved.filter("t <> before").isEmpty():
                break
        joined = left.join(to.toDF("ca", "ta"), "ca").join(to.toDF("cb", "tb"), "cb").filter("ta <> tb")
        near, off = F.least("ta", "tb").alias("ca"), F.greatest("ta", "tb").alias("cb")
        left = materialise(joined.groupBy(near, off).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w", "ca", "cb"))
    if not chosen:
        return edges.select("a", "b", "w").limit(0)
    return reduce(DataFrame.unionByName, chosen).distinct()


def spanning_tree(places: DataFrame) -> DataFrame:
    """``a, b, height``: the edges of a minimum spanning tree of each group and their lengths."""
    tree = lightest_tree(candidate_edges(places))
    return tree.select("a", "b", F.sqrt("w").alias("height"))
