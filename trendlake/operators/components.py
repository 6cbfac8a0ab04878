"""Connected components by smallest label, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.session import discard, materialise


def connected_components(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """``id, component`` where the component is its smallest id.

    ``nodes`` has ``id``, ``edges`` has ``a, b`` (either direction once). Each
    round offers the smallest label among a node's neighbours to the node and
    to the node its label points at, then follows the label's own label, so the
    number of rounds grows with the logarithm of the longest path. Every round
    is written out, in ``parts`` files at most if given, which keeps plans short
    and survives lost executors; the round before is then removed.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")), parts)
    labels = nodes.select("id", F.col("id").alias("component"))
    last = None
    while True:
        own = labels.select(F.col("id").alias("a"), F.col("component").alias("own"))
        other = labels.select(F.col("id").alias("b"), F.col("component").alias("other"))
        near = (
            both.join(other, "b").join(own, "a")
            .select(F.explode(F.array("a", "own")).alias("id"), "other")
            .groupBy("id").agg(F.min("other").alias("near"))
        )
        stepped = labels.join(near, "id", "left").select(
            "id", "component", F.least("component", F.coalesce("near", "component")).alias("next")
        )
        # The round's two uses of ``stepped`` share its shuffles.
        jump = stepped.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        moved = materialise(
            stepped.join(jump, "next").select("id", F.col("component").alias("before"), F.least("next", "jump").alias("component")), parts
        )
        if last is not None:
            discard(last)
        last, labels = moved, moved.select("id", "component")
        if moved.filter(F.col("before") != F.col("component")).isEmpty():
            discard(both)
            return labels
