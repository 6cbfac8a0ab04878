"""Single-linkage clusters of the plane, for all rows or per group.

The merge heights of single linkage are the edge lengths of a minimum spanning
tree, plus one 0 for every row that stands where another one does. Cutting the
tree at a height leaves the clusters; the height is given, or found from a
number of clusters, the largest jump between heights, or their mean and
deviation. Everything is exact at every size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.operators.components import connected_components
from trendlake.operators.dbscan import linked_places, standardized_plane
from trendlake.operators.joins import number_rows
from trendlake.operators.quantiles import null_safe_join
from trendlake.operators.spanning_tree import prim, spanning_tree
from trendlake.session import materialise

#: Rows of a group that one task may cluster by itself.
SMALL = 4096


@dataclass
class Tree:
    """The single-linkage trees of all groups.

    ``rows`` has ``by, key, x, y, grp, place``, ``places`` one row for each
    ``grp, place`` with its ``rows`` and smallest ``key``, ``edges`` the
    spanning tree's ``grp, a, b, height``.
    """

    by: list[str]
    key: str
    rows: DataFrame
    places: DataFrame
    edges: DataFrame

    def heights(self) -> DataFrame:
        """``grp, height``: one row for each merge."""
        copies = self.places.filter("rows > 1").select("grp", F.explode(F.sequence(F.lit(2).cast("long"), F.col("rows"))))
        return self.edges.select("grp", "height").unionByName(copies.select("grp", F.lit(0.0).alias("height")))

    def ordered_heights(self) -> DataFrame:
        """``grp, height, step``: merges of a group numbered from 1 by height."""
        ordered = materialise(number_rows(
            self.heights().withColumn("_o", F.struct("grp", "height", F.monotonically_increasing_id())), "_o", "_n"
        ).select("grp", "height", "_n"))
        first = ordered.groupBy("grp").agg(F.min("_n").alias("_f"))
        return ordered.join(materialise(first), "grp").select("grp", "height", (F.col("_n") - F.col("_f") + 1).alias("step"))

    def sizes(self) -> DataFrame:
        return self.places.groupBy("grp").agg(F.sum("rows").alias("rows"))

    def at_height(self, height: float | DataFrame) -> DataFrame:
        """``by, key, x, y, cluster``: a cluster is named by its smallest key.

        ``height`` is one number or a ``grp, cut`` table; groups without a cut
        are one cluster.
        """
        if isinstance(height, DataFrame):
            kept = self.edges.join(height, "grp", "left").filter(F.col("cut").isNull() | (F.col("height") <= F.col("cut")))
        else:
            kept = self.edges.filter(F.col("height") <= F.lit(float(height)))
        parts = connected_components(self.places.select(F.col("place").alias("id")), materialise(kept.select("a", "b")))
        named = materialise(self.places.join(parts.withColumnRenamed("id", "place"), "place"))
        first = materialise(named.groupBy("component").agg(F.min("key").alias("cluster")))
        labels = named.join(first, "component").select("place", "cluster")
        return self.rows.join(labels, "place").select(*self.by, self.key, "x", "y", "cluster")

    def cut_by_count(self, clusters: int) -> DataFrame:
        """At most ``clusters`` clusters in every group: the lowest cut with no more; equal heights merge together."""
        if clusters < 1:
            raise ValueError("a group has one cluster or more")
        return self._at_step(self.sizes().select("grp", (F.col("rows") - clusters).alias("step")))

    def cut_at_largest_jump(self) -> DataFrame:
        """As many clusters as are left before the step with the largest jump to the next height."""
        return self._at_step(self.largest_jump().select("grp", F.col("before").alias("step")))

    def largest_jump(self) -> DataFrame:
        """``grp, before, jump``: the merges made before the one from which the next is the farthest; of equal jumps the first."""
        steps = materialise(self.ordered_heights())
        after = steps.select("grp", (F.col("step") - 1).alias("step"), F.col("height").alias("after"))
        best = F.min_by(F.struct((F.col("step") - 1).alias("before"), (F.col("after") - F.col("height")).alias("jump")),
                        F.struct((F.col("height") - F.col("after")).alias("j"), "step"))
        return steps.join(after, ["grp", "step"]).groupBy("grp").agg(best.alias("b")).select("grp", "b.*")

    def cut_by_deviation(self) -> DataFrame:
        """Cut at mean + population deviation of the heights."""
        cut = self.heights().groupBy("grp").agg((F.avg("height") + F.stddev_pop("height")).alias("cut"))
        return self.at_height(materialise(cut))

    def _at_step(self, steps: DataFrame) -> DataFrame:
        """Cuts at the height of the given merge of each group, at 0 below merge 1: equal rows are never told apart."""
        heights = self.ordered_heights().join(materialise(steps).withColumnRenamed("step", "want"), "grp")
        cut = heights.groupBy("grp").agg(
            F.coalesce(F.max(F.when(F.col("step") == F.col("want"), F.col("height"))), F.lit(0.0)).alias("cut")
        )
        return self.at_height(materialise(cut))


def _plane(df: DataFrame, key: str, score: str | Sequence[str], by: list[str], dims: int | None, standardize: bool) -> DataFrame:
    """``by, key, x, y, grp``, written; groups are numbered, null is one of them."""
    finite = [F.abs(F.col(c)) < float("inf") for c in ("x", "y")]  # false for null and NaN, too
    plane = standardized_plane(df, [*by, key], score, dims, standardize).filter(finite[0] & finite[1])
    plane = plane.withColumns({c: F.col(c) + 0.0 for c in ("x", "y")})
    if not by:
        return materialise(plane.withColumn("grp", F.lit(0).cast("long")))
    plane = materialise(plane)
    groups = plane.select(*by).distinct().withColumn("_order", F.to_json(F.struct(*by)))
    numbered = materialise(number_rows(groups, "_order", "grp").select(*by, "grp"))
    return materialise(null_safe_join(plane, numbered, by))


def linkage_tree(
    df: DataFrame, key: str, score: str | Sequence[str], by: Sequence[str] = (), dims: int | None = None, standardize: bool = True
) -> Tree:
    """The single-linkage tree of each group of the ``by`` columns (null is a group), of all rows without them.

    The plane is standardized over all rows. A key may stand in several
    groups, and several times in one. Rows without finite coordinates are left out.
    """
    by = list(by)
    plane = _plane(df, key, score, by, dims, standardize)
    spots = plane.groupBy("grp", "x", "y").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("key"))
    places = materialise(number_rows(spots.withColumn("_o", F.struct("grp", "x", "y")), "_o", "place").drop("_o"))
    rows = materialise(plane.join(places.select("grp", "x", "y", "place"), ["grp", "x", "y"]))
    tree = spanning_tree(places.select("grp", F.col("place").alias("id"), "x", "y"))
    edges = materialise(tree.join(places.select(F.col("place").alias("a"), "grp"), "a").select("grp", "a", "b", "height"))
    return Tree(by, key, rows, places, edges)


def _small_groups(plane: DataFrame, key: str, height: float) -> DataFrame:
    """``plane`` with ``cluster``: a group of few rows is clustered by one task."""

    def label(rows: pa.Table) -> pa.Table:
        order, by, w = prim(rows["x"].to_numpy(), rows["y"].to_numpy())
        part = np.zeros(rows.num_rows, np.int64)
        linked = w <= height * height
        for row, before, same in zip(order.tolist(), by.tolist(), linked.tolist()):
            part[row] = part[before] if same else row
        first = pa.table({"part": part, "key": rows[key]}).group_by("part").aggregate([("key", "min")])
        at = np.searchsorted(np.sort(first["part"].to_numpy()), part)
        names = first.sort_by("part")["key_min"].take(pa.array(at))
        return rows.append_column("cluster", names.cast(rows.schema.field(key).type))

    shape = plane.select("*", F.col(key).alias("cluster")).schema
    return plane.groupBy("grp").applyInArrow(label, shape)


def single_linkage(
    df: DataFrame, key: str, score: str | Sequence[str], height: float, by: Sequence[str] = (),
    dims: int | None = None, standardize: bool = True,
) -> DataFrame:
    """``by, key, x, y, cluster`` of the trees cut at ``height`` (above 0); a cluster is named by its smallest key.

    Rows are joined to their clusters by group and place, so a key may stand
    in several groups. Rows without finite coordinates are left out.
    """
    by = list(by)
    plane = _plane(df, key, score, by, dims, standardize)
    out = [*by, key, "x", "y", "cluster"]
    if not by:
        return plane.join(linked_places(plane, key, height), ["grp", "x", "y"]).select(*out)
    sizes = materialise(plane.groupBy("grp").agg((F.count(F.lit(1)) <= SMALL).alias("small")))
    sized = plane.join(sizes, "grp")
    labelled = _small_groups(sized.filter("small").drop("small"), key, height).select(*out)
    if sizes.filter(~F.col("small")).isEmpty():
        return labelled
    large = materialise(sized.filter(~F.col("small")).drop("small"))
    return labelled.unionByName(large.join(linked_places(large, key, height), ["grp", "x", "y"]).select(*out))
