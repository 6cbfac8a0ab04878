"""Scaled feature vectors and reduced spaces, with the row keys kept all the way through.

Fits leave only dims x dims figures on the driver; rows are projected by
expressions, so no positional join is ever needed afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, features: str | Sequence[str], output: str = "raw_vector", invalid: str = "skip") -> DataFrame:
    """Adds a vector column from an array column or from numeric columns; ``skip`` leaves out incomplete rows."""
    if isinstance(features, str):
        whole = F.col(features).isNotNull() & ~F.exists(features, lambda v: v.isNull())
        rows = df.filter(whole) if invalid == "skip" else df
        return rows.withColumn(output, array_to_vector(F.col(features).cast("array<double>")))
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid=invalid).transform(df)


def scale(
    df: DataFrame, features: str | Sequence[str], center: bool = False, output: str = "scaled", invalid: str = "skip"
) -> tuple[DataFrame, StandardScalerModel]:
    """Unit sample deviation per feature; ``center`` also subtracts the mean."""
    rows = assemble(df, features, "_raw", invalid)
    model = StandardScaler(inputCol="_raw", outputCol=output, withMean=center, withStd=True).fit(rows)
    return model.transform(rows).drop("_raw"), model


@dataclass
class Reduction:
    """A fitted reduction: column j of ``loadings`` maps features to component j."""

    variance: list[float]
    loadings: np.ndarray
    components: int

    def table(self, spark) -> DataFrame:
        """``component, variance, cumulative, kept``."""
        total = np.cumsum(self.variance)
        rows = [(i + 1, float(v), float(c), i < self.components) for i, (v, c) in enumerate(zip(self.variance, total))]
        return spark.createDataFrame(rows, "component int, variance double, cumulative double, kept boolean")

    def loadings_table(self, spark, features: Sequence[str]) -> DataFrame:
        """``feature, component, loading``."""
        rows = [
            (f, j + 1, float(self.loadings[i, j]))
            for i, f in enumerate(features) for j in range(self.loadings.shape[1])
        ]
        return spark.createDataFrame(rows, "feature string, component int, loading double")


def _choose(variance: Sequence[float], threshold: float | None, k: int | None) -> int:
    """Number of components: ``k``, or the first count whose cumulative share reaches the threshold."""
    if k is not None:
        return k
    if threshold is None:
        return len(variance)
    reached = np.flatnonzero(np.cumsum(variance) >= threshold - 1e-12)
    return int(reached[0]) + 1 if len(reached) else len(variance)


def _oriented(matrix: np.ndarray) -> np.ndarray:
    """Flip columns so that each one's largest loading is positive."""
    top = matrix[np.abs(matrix).argmax(axis=0), np.arange(matrix.shape[1])]
    return matrix * np.where(top < 0, -1.0, 1.0)


def fit_pca(df: DataFrame, vector: str, dims: int, threshold: float | None = 0.95, k: int | None = None) -> Reduction:
    """One fit with all components; the kept count is chosen from it, so nothing is fitted twice."""
    model = PCA(k=dims, inputCol=vector, outputCol="_pc").fit(df.select(vector))
    variance = [float(v) for v in model.explainedVariance.toArray()]
    return Reduction(variance, _oriented(np.array(model.pc.toArray())), _choose(variance, threshold, k))


def fit_svd(df: DataFrame, vector: str, dims: int, threshold: float | None = 0.9, k: int | None = None) -> Reduction:
    """Singular value decomposition; shares are s^2 / sum(s^2) of the uncentred matrix.

    Loadings are V / s, so projecting a row gives its row of U.
    """
    rows = MLUtils.convertVectorColumnsFromML(df.select(vector), vector)
    svd = RowMatrix(rows).computeSVD(dims, computeU=False)
    s = np.array(svd.s.toArray())
    share = s**2 / float((s**2).sum())
    v = _oriented(np.array(svd.V.toArray()))
    return Reduction([float(x) for x in share], v / s, _choose(list(share), threshold, k))


def _products(values: Sequence[Column], weights: np.ndarray, offset: float) -> Column:
    return reduce(lambda a, b: a + b, [v * F.lit(float(w)) for v, w in zip(values, weights)], F.lit(float(offset)))


def project(array: Column, matrix: np.ndarray, offset: np.ndarray | None = None) -> Column:
    """Row array times a small matrix plus an offset, as one array expression."""
    dims, n = matrix.shape
    offset = np.zeros(n) if offset is None else offset
    if dims * n <= 300:
        values = [F.get(array, F.lit(i)) for i in range(dims)]
        return F.array(*[_products(values, matrix[:, j], offset[j]) for j in range(n)])
    columns = F.array(*[
        F.struct(F.array(*[F.lit(float(x)) for x in matrix[:, j]]).alias("w"), F.lit(float(offset[j])).alias("o")) for j in range(n)
    ])
    return F.transform(
        columns, lambda c: F.aggregate(F.zip_with(c.w, array, lambda a, b: a * b), c.o, lambda s, v: s + v)
    )


def reduce_rows(df: DataFrame, fit: Reduction, vector: str, output: str = "score", center: bool = False) -> DataFrame:
    """Adds the kept component scores as an array.

    Scores are not centred by default, like the library's own transform;
    ``center`` subtracts the scores of the mean row (one row to the driver).
    """
    matrix = fit.loadings[:, : fit.components]
    offset = None
    if center:
        mean = np.array(df.agg(Summarizer.mean(F.col(vector)).alias("m")).first()["m"].toArray())
        offset = -(mean @ matrix)
    # The array is a column of its own, so it is built once per row and not once per product.
    rows = df.withColumn("_values", vector_to_array(vector))
    return rows.withColumn(output, project(F.col("_values"), matrix, offset)).drop("_values")
