"""K-means and bisecting k-means: sweeps over k and seeds, labels, centres."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.session import side_by_side
from trendlake.sources.files import hash_sample

#: Rows of a part when vectors are spread: a task reads one part in every pass.
PART_ROWS = 1 << 18


@dataclass
class Sweep:
    """Scores of all fits and the chosen one, which is kept rather than fitted again."""

    vector: str
    scores: list[tuple[int, int, float]] = field(default_factory=list)  # k, seed, silhouette
    k: int | None = None
    seed: int | None = None
    model: object = None

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.scores, "k int, seed long, silhouette double")

    def order(self) -> list[int]:
        """New label of each fitted label: clusters are numbered by their centres, so labels repeat."""
        centres = [tuple(c) for c in self.model.clusterCenters()]
        ranked = sorted(range(len(centres)), key=lambda i: centres[i])
        return [ranked.index(i) for i in range(len(centres))]

    def label(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``df`` with its cluster label; every other column stays."""
        names = F.array(*[F.lit(n) for n in self.order()])
        rows = with_vector(df.drop(prediction), self.vector)
        labelled = self.model.transform(rows, {self.model.predictionCol: "_fitted"})
        return labelled.withColumn(prediction, F.get(names, F.col("_fitted")).cast("int")).drop("_fitted")

    def centres(self, spark) -> DataFrame:
        """``prediction, dim, centre``."""
        rows = [
            (new, j, float(x))
            for new, c in zip(self.order(), self.model.clusterCenters()) for j, x in enumerate(c)
        ]
        return spark.createDataFrame(rows, "prediction int, dim int, centre double")


def with_vector(df: DataFrame, column: str) -> DataFrame:
    """Turns an array column into a vector column of the same name; vectors pass unchanged."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return df.withColumn(column, array_to_vector(F.col(column).cast("array<double>")))
    return df


def silhouette(predictions: DataFrame, vector: str, prediction: str = "prediction") -> float:
    """Squared-Euclidean silhouette over the given rows; -1 where it is undefined (a single cluster)."""
    if predictions.select(prediction).distinct().limit(2).count() < 2:
        return -1.0
    evaluator = ClusteringEvaluator(featuresCol=vector, predictionCol=prediction, metricName="silhouette")
    return float(evaluator.evaluate(predictions))


def _estimator(kind: str, vector: str, k: int, seed: int):
    if kind == "bisecting":
        return BisectingKMeans(featuresCol=vector, k=k, seed=seed)
    return KMeans(featuresCol=vector, k=k, seed=seed, maxIter=20, tol=1e-4, initMode="k-means||")


def _fits(rows: DataFrame, scored: DataFrame, vector: str, ks: Iterable[int], seeds: Sequence[int], kind: str):
    """(k, seed, silhouette, model) of every setting, seed by seed."""
    # Given the cached table itself, a fit turns its columns back into rows on
    # every pass. Behind a filter it keeps its own row cache: two to three times faster.
    data = rows.filter(F.col(vector).isNotNull())

    def one(setting):
        seed, k = setting
        try:
            model = _estimator(kind, vector, k, seed).fit(data)
        except PySparkException:
            return k, seed, -1.0, None  # a k that cannot be fitted scores -1
        return k, seed, silhouette(model.transform(scored), vector), model

    return side_by_side(rows.sparkSession, one, [(seed, k) for seed in seeds for k in ks])


def sweep(
    df: DataFrame, vector: str, ks: Iterable[int] = range(2, 8), seed: int = 1, kind: str = "kmeans",
    sample_keys: Sequence[str] | None = None, partitions: int | None = None, sample_fraction: float = 0.1,
) -> Sweep:
    """Fit every k and keep the one with the best silhouette, the smaller k on ties.

    ``partitions`` spreads the vectors evenly once before the many passes over
    them, for inputs that come in few or uneven splits: over that many parts, or
    over more, so that no part has more than about ``PART_ROWS`` rows.

    ``sample_keys`` turns on the sampled score: the rows of a share of the
    keys, chosen by their hash, are scored. Fitting always sees all rows.
    """
    rows = with_vector(df, vector).select(vector, *[k for k in sample_keys or () if k != vector])
    if partitions:
        rows = rows.repartition(max(partitions, -(-rows.count() // PART_ROWS)))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scored = rows
        if sample_keys:
            scored = hash_sample(rows, sample_keys, sample_fraction, 42)
        out, best = Sweep(vector), -2.0
        for k, s, score, model in _fits(rows.select(vector), scored.select(vector), vector, list(ks), [seed], kind):
            out.scores.append((k, s, score))
            if model is not None and score > best:
                best, out.k, out.seed, out.model = score, k, s, model
        return out
    finally:
        rows.unpersist()


def stable_sweep(
    df: DataFrame, vector: str, ks: Iterable[int] = range(2, 8), seeds: Sequence[int] = (1, 2, 3),
) -> Sweep:
    """The k whose silhouette varies least over the seeds, fitted with its best seed."""
    rows = with_vector(df, vector).select(vector).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out, models = Sweep(vector), {}
        for k, s, score, model in _fits(rows, rows, vector, list(ks), list(seeds), "kmeans"):
            out.scores.append((k, s, score))
            held = models.get(k)
            if model is not None and (held is None or score > held[0]):
                models[k] = (score, s, model)
        spread = {k: np.var([x for kk, _, x in out.scores if kk == k]) for k in models}
        out.k = min(spread, key=lambda k: (spread[k], k))
        _, out.seed, out.model = models[out.k]
        return out
    finally:
        rows.unpersist()


def stability_table(scores: DataFrame) -> DataFrame:
    """``k, mean_silhouette, variance`` over the seeds."""
    return scores.groupBy("k").agg(
        F.avg("silhouette").alias("mean_silhouette"), F.var_pop("silhouette").alias("variance")
    )
