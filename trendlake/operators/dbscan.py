"""Density-based clustering in the plane, exact and without all pairs.

Equal places are first merged into one location with a count. Locations fall
into cells whose diagonal is eps, so a cell with enough rows is all core and
its core locations are connected without looking at a single pair. What is left:

* locations of thin cells (fewer rows than ``min_samples``) count the rows
  around them. A crowded neighbour cell is spread over salts.
* two neighbouring core cells are linked if any two core locations are within
  eps. Boxes around groups of locations decide that: a pair of boxes is
  surely near, surely far, or is split in sixteen and looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.functions.vectors import with_coordinates
from trendlake.operators.clean import zscore
from trendlake.operators.cluster import silhouette
from trendlake.operators.components import connected_components
from trendlake.operators.joins import number_rows
from trendlake.session import materialise, side_by_side

_REACH = 2  # neighbouring cells to look at on each side
_ROUNDS = 12
_SALT_ROWS = 50_000


def standardized_plane(
    df: DataFrame, keep: Sequence[str], score: str | Sequence[str], dims: int | None = None, standardize: bool = True
) -> DataFrame:
    """``keep, x, y``: the first two dimensions, with mean 0 and sample deviation 1 if asked."""
    rows = with_coordinates(df, keep, score, max(2, dims or 2)).select(*keep, F.col("x0").alias("x"), F.col("x1").alias("y"))
    return zscore(rows, ["x", "y"]) if standardize else rows


def _cell_id(cx: Column, cy: Column) -> Column:
    """A cell of a group. Groups have cells of their own, so they never meet."""
    return F.struct(F.col("grp"), cx.alias("cx"), cy.alias("cy"))


def _neighbours(df: DataFrame) -> DataFrame:
    """One row per cell around, the own one included, as ``cell``."""
    offsets = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
        for i in range(-_REACH, _REACH + 1) for j in range(-_REACH, _REACH + 1)
    ])
    moved = df.withColumn("o", F.explode(offsets))
    return moved.withColumn("cell", _cell_id(F.col("cx") + F.col("o.i"), F.col("cy") + F.col("o.j"))).drop("o")


def _near(eps: float) -> Column:
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    return dx * dx + dy * dy <= F.lit(eps * eps)


def _around(probes: DataFrame, targets: DataFrame, salts: DataFrame, eps: float, carry: str) -> DataFrame:
    """Probe locations (of thin cells) with the target locations within eps of them."""
    spread = (
        _neighbours(probes.select("grp", "x", "y", "cx", "cy")).join(salts, "cell")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    )
    salted = targets.select("cell", "salt", F.col("x").alias("tx"), F.col("y").alias("ty"), carry)
    return spread.join(salted, ["cell", "salt"]).filter(_near(eps))


def _boxes(cores: DataFrame, level: int, side: float) -> DataFrame:
    """Bounding boxes of the core locations in each of the 4^level x 4^level parts of a cell."""
    part = lambda c, cell: F.floor((F.col(c) / side - F.col(cell)) * float(4**level))
    return cores.groupBy("cell", "grp", "cx", "cy", part("x", "cx").alias("bx"), part("y", "cy").alias("by")).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )


_BOX = ["bx", "by", "x0", "x1", "y0", "y1"]


def _sided(boxes: DataFrame, side: str) -> DataFrame:
    return boxes.select(F.col("cell").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in _BOX])


def _judged(pairs: DataFrame, eps: float) -> DataFrame:
    """Keeps pairs of boxes that may be within eps; ``sure`` when every pair of their locations is."""
    g = F.col
    gap = lambda lo, hi: F.greatest(F.lit(0.0), g(f"b_{lo}") - g(f"a_{hi}"), g(f"a_{lo}") - g(f"b_{hi}"))
    far = lambda lo, hi: F.greatest(g(f"b_{hi}") - g(f"a_{lo}"), g(f"a_{hi}") - g(f"b_{lo}"))
    nx, ny, fx, fy = gap("x0", "x1"), gap("y0", "y1"), far("x0", "x1"), far("y0", "y1")
    kept = pairs.filter(nx * nx + ny * ny <= eps * eps)
    return kept.withColumn("sure", fx * fx + fy * fy <= eps * eps)


def _cell_links(cores: DataFrame, side: float, eps: float) -> DataFrame:
    """``a, b``: neighbouring cells with core locations within eps of each other."""
    first = _boxes(cores, 0, side)
    left = first.withColumnRenamed("cell", "own")
    around = _neighbours(left).filter(F.col("cell") > F.col("own"))
    a_side = around.select("cell", F.col("own").alias("a"), *[F.col(c).alias(f"a_{c}") for c in _BOX])
    b_side = _sided(first, "b").withColumn("cell", F.col("b"))
    pairs = materialise(_judged(a_side.join(b_side, "cell").drop("cell"), eps))
    found = pairs.filter("sure").select("a", "b").distinct()
    links = [found]
    open_pairs = pairs.join(found, ["a", "b"], "left_anti")
    for level in range(1, _ROUNDS + 1):
        if open_pairs.isEmpty():
            break
        still = open_pairs.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
        boxes = _boxes(cores.join(still, "cell", "left_semi"), level, side)
        parent = open_pairs.select("a", "b", "a_bx", "a_by", "b_bx", "b_by")
        a = _sided(boxes, "a").withColumns({"pa_x": F.floor(F.col("a_bx") / 4), "pa_y": F.floor(F.col("a_by") / 4)})
        b = _sided(boxes, "b").withColumns({"pb_x": F.floor(F.col("b_bx") / 4), "pb_y": F.floor(F.col("b_by") / 4)})
        parent = parent.toDF("a", "b", "pa_x", "pa_y", "pb_x", "pb_y")
        split = parent.join(a, ["a", "pa_x", "pa_y"]).join(b, ["b", "pb_x", "pb_y"]).select(
            "a", "b", *[f"a_{c}" for c in _BOX], *[f"b_{c}" for c in _BOX]
        )
        pairs = materialise(_judged(split, eps))
        found = pairs.filter("sure").select("a", "b").distinct()
        links.append(found)
        open_pairs = pairs.join(found, ["a", "b"], "left_anti")
    else:
        # Boxes no wider than rounding error are still open: compare their few places directly.
        level_side = float(4**_ROUNDS)
        spot = cores.select(
            "cell", F.floor((F.col("x") / side - F.col("cx")) * level_side).alias("bx"),
            F.floor((F.col("y") / side - F.col("cy")) * level_side).alias("by"), "x", "y",
        )
        rest = open_pairs.select("a", "b", "a_bx", "a_by", "b_bx", "b_by")
        rest = rest.join(spot.toDF("a", "a_bx", "a_by", "x", "y"), ["a", "a_bx", "a_by"])
        rest = rest.join(spot.toDF("b", "b_bx", "b_by", "tx", "ty"), ["b", "b_bx", "b_by"])
        links.append(rest.filter(_near(eps)).select("a", "b").distinct())
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def _cores(plane: DataFrame, key: str, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Core places ``grp, x, y, cell, salt, component, first_key``, the thin places, and the cells' salts.

    ``plane`` has ``grp, x, y`` and the key. Where every row is a core, no place is thin.
    """
    # A hair under eps / sqrt(2), so that one cell never spans more than eps.
    side = eps / math.sqrt(2.0) * (1.0 - 1e-9)
    places = plane.groupBy("grp", "x", "y").agg(F.count("*").alias("n"), F.min(key).alias("first_key"))
    places = places.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    places = materialise(places.withColumn("cell", _cell_id(F.col("cx"), F.col("cy"))))
    cells = places.groupBy("cell").agg(
        (F.sum("n") >= min_samples).alias("crowded"), F.ceil(F.count("*") / F.lit(_SALT_ROWS)).cast("int").alias("salts")
    )
    if min_samples > 1:
        cells = materialise(cells)
        places = materialise(
            places.join(cells, "cell").withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.col("salts").cast("long")).cast("int"))
        )
        thin = places.filter(~F.col("crowded"))
        counted = _around(thin, places, cells.select("cell", "salts"), eps, "n").groupBy("grp", "x", "y").agg((F.sum("n") >= min_samples).alias("core"))
        thin = materialise(thin.join(counted, ["grp", "x", "y"], "left").withColumn("core", F.coalesce("core", F.lit(False))))
        cores = materialise(places.filter("crowded").withColumn("core", F.lit(True)).unionByName(thin.filter("core")))
    else:
        cores, thin = places.withColumn("salt", F.lit(0)), None

    nodes = cores.select(F.col("cell").alias("id")).distinct()
    parts = connected_components(nodes, _cell_links(cores, side, eps)).withColumnRenamed("id", "cell")
    owned = cores.join(parts, "cell").select("grp", "x", "y", "cell", "salt", "component", "first_key")
    return materialise(owned), thin, cells.select("cell", "salts")


def dbscan(
    df: DataFrame, key: str, score: str | Sequence[str], eps: float, min_samples: int,
    dims: int | None = None, standardize: bool = True,
) -> DataFrame:
    """``key, x, y, cluster``; noise is -1.

    A row counts itself. Clusters are numbered 0.. by the smallest key among
    their core rows; a border row takes the smallest cluster it touches.
    """
    # Written once: places are joined back by value, so rows must not be scaled anew.
    plane = materialise(standardized_plane(df, [key], score, dims, standardize).withColumn("grp", F.lit(0).cast("long")))
    owned, thin, salts = _cores(plane, key, eps, min_samples)
    firsts = owned.groupBy("component").agg(F.min("first_key").alias("k"))
    numbers = number_rows(firsts, "k", "cluster").select("component", F.col("cluster").cast("int").alias("cluster"))
    owned = owned.join(numbers, "component").select("grp", "x", "y", "cell", "salt", "cluster")
    labels = owned.select("x", "y", "cluster")
    if thin is not None:
        owned = materialise(owned)
        border = _around(thin.filter(~F.col("core")), owned, salts, eps, "cluster").groupBy("x", "y").agg(F.min("cluster").alias("cluster"))
        labels = owned.select("x", "y", "cluster").union(border.select("x", "y", "cluster"))
    return plane.join(labels, ["x", "y"], "left").select(key, "x", "y", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def linked_places(plane: DataFrame, key: str, reach: float) -> DataFrame:
    """``grp, x, y, cluster``: places of a group joined by chains of steps no longer than ``reach``, named by the smallest key."""
    owned, _, _ = _cores(plane, key, reach, 1)
    first = materialise(owned.groupBy("component").agg(F.min("first_key").alias("cluster")))
    return owned.join(first, "component").select("grp", "x", "y", "cluster")


def dbscan_sweep(
    df: DataFrame, key: str, score: str | Sequence[str], eps_values: Iterable[float], min_samples_values: Iterable[int],
    dims: int | None = None, standardize: bool = True,
) -> DataFrame:
    """``eps, min_samples, silhouette, n_clusters, noise_ratio`` for every setting with two labels or more.

    Noise counts as a label of its own in the silhouette.
    """
    plane = materialise(standardized_plane(df, [key], score, dims, standardize))

    def score_one(setting):
        eps, m = setting
        labels = materialise(dbscan(plane, key, ["x", "y"], eps, m, standardize=False))
        figures = labels.agg(
            F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"),
            F.avg((F.col("cluster") < 0).cast("int")).alias("noise"),
        ).first()
        rows = labels.select(array_to_vector(F.array("x", "y")).alias("v"), F.col("cluster").cast("double").alias("prediction"))
        return float(eps), int(m), silhouette(rows, "v"), int(figures["clusters"]), float(figures["noise"])

    settings = [(eps, m) for eps in eps_values for m in list(min_samples_values)]
    scored = side_by_side(df.sparkSession, score_one, settings)
    out = [s for s in scored if s[3] + (s[4] > 0) >= 2]
    return df.sparkSession.createDataFrame(out, "eps double, min_samples int, silhouette double, n_clusters long, noise_ratio double")


def best_setting(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("silhouette"), "eps", "min_samples").limit(1)
