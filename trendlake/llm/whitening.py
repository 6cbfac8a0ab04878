"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers, so the centred rows are exact up to one
rounding. A Gram pass sums the products of the rows of every task; the
Cholesky factor of the (at first shifted) Gram matrix orthogonalises the rows
by a triangular solve, and further passes repeat that on the solved rows until
their Gram matrix is the identity. The composed factors are the R of the
centred rows; its singular value decomposition gives the components.

Rows whose vector is null, or holds null, non-finite or enormous (from 2**46)
entries take no part. Where lengths differ, the commonest length counts (of
equally common ones the longest), other rows take no part. Directions without
variance have no component. Null ids and repeated rows are rows like others.
An empty table, or one without variance, gives an empty table. Only the id and
the vector column are read, so that other columns never clash.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.llm.tables import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000
#: Entries from here on have no exact whole number.
_TOO_LARGE = float(2**46)
_EPS = float(np.finfo(float).eps)
_MAX_PASSES = 8
#: Entries of a block that a task works on at once.
_BLOCK = 1 << 20


@dataclass
class Whitening:
    """``components`` (one per row) of rows ``x``; ``base + rest / n`` is the mean, ``eigenvalues`` fall."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of ``(n * x - S) ** 2``; null where they pass 64 bits."""
        near = np.square(self.centred(x) * self.n).sum(axis=1)
        if near.max(initial=0.0) < 9.2e18 and self.n * np.abs(x - self.base).max(initial=0) < 2**62:
            return np.square(self.n * (x - self.base) - self.rest).sum(axis=1).tolist()
        whole = [sum((self.n * int(v - b) - int(r)) ** 2 for v, b, r in zip(row, self.base, self.rest)) for row in x]
        return [v if v < 2**63 else None for v in whole]


def whole_rows(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, x``: the rows that take part, as whole numbers, written once."""
    usable = F.forall("v", lambda c: F.coalesce(F.abs(c) < _TOO_LARGE, F.lit(False)))
    rows = written(
        df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & usable)
        .select("id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long")).alias("x"))
    )
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (common["d"] if common else 0))


def _blocks(batches, d: int):
    """(ids, x) for a bounded number of rows at a time."""
    for batch in batches:
        step = max(1, _BLOCK // d)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows @ inv(upper)`` by forward substitution: panels of columns, column by column inside one."""
    q = np.empty(rows.shape, order="F")
    for a in range(0, len(upper), 64):
        b = min(a + 64, len(upper))
        left = rows[:, a:b] - q[:, :a] @ upper[:a, a:b]
        for j in range(a, b):
            q[:, j] = (left[:, j - a] - q[:, a:j] @ upper[a:j, j]) / upper[j, j]
    return q


def gram(rows: DataFrame, d: int, prepare: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """Gram matrix of the prepared rows, with their sums as last row: (k + 1) x k.

    A task sends its own sums only, and each row of the matrix is summed by
    itself. What reaches the driver depends on the width alone.
    """
    def local(batches):
        total = np.zeros((k + 1, k))
        for _, x in _blocks(batches, d):
            q = prepare(x)
            total[:k] += q.T @ q
            total[k] += q.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k + 1)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "values"]
        )

    def summed(table: pa.Table) -> pa.Table:
        total = table.column("values").combine_chunks().flatten().to_numpy().reshape(-1, k).sum(axis=0)
        return pa.table({"i": table.column("i")[:1], "values": pa.array([total], pa.list_(pa.float64()))})

    schema = "i long, values array<double>"
    sums = rows.select("id", "x").mapInArrow(local, schema).groupBy("i").applyInArrow(summed, schema)
    return np.array([r["values"] for r in sorted(sums.collect(), key=lambda r: r["i"])]).reshape(-1, k)


def shifted_cholesky(g: np.ndarray) -> np.ndarray:
    """Upper factor of ``g``, shifted by as little above its rounding as makes it definite, and not at all where near the identity."""
    d = len(g)
    shift = 0.0 if np.abs(g - np.eye(d)).max() < 0.5 else 100 * d * _EPS * np.trace(g)
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, d * _EPS * np.trace(g))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all of ``rows`` (``id, x``); None where nothing varies."""
    sums = (
        rows.select(F.posexplode("x")).groupBy("pos")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("col").cast("decimal(20,0)")).alias("s")).orderBy("pos").collect()
    )
    if not sums:
        return None
    n, d = sums[0]["n"], len(sums)
    base = np.array([int(r["s"]) // n for r in sums], dtype=np.int64)
    rest = np.array([int(r["s"]) % n for r in sums], dtype=np.int64)
    uppers: list[np.ndarray] = []
    while len(uppers) < _MAX_PASSES:
        def orthogonal(x: np.ndarray, solve: Sequence[np.ndarray] = tuple(uppers)) -> np.ndarray:
            q = (x - base) - rest / n
            for upper in solve:
                q = solved(q, upper)
            return q

        g = gram(rows, d, orthogonal, d)[:d]
        if not g.any():
            return None
        uppers.append(shifted_cholesky(g))
        if np.abs(g - np.eye(d)).max() < 1e-8:
            break  # this factor leaves nothing but rounding
    r = np.eye(d)
    for upper in uppers:
        r = upper @ r
    _, size, axes = np.linalg.svd(r)
    e = size**2 / n
    live = int((size > 8 * d * _EPS * size[0]).sum())
    keep = min(components, live)
    return Whitening(n, base, rest, axes[:keep], e[:keep], float(e.sum()), len(uppers))


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: n, deviation, whitened, explained and the whitening's largest error.

    Components are numbered from 1 by falling variance, their sign is that of
    the decomposition, the same for all rows.
    """
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    rows = whole_rows(df, id_col, vector)
    model = fit(rows, components)
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d, k = len(model.base), len(model.eigenvalues)
    sums = gram(rows, d, model.whitened, k)
    mean = sums[k] / model.n
    error = float(np.abs(sums[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())
    explained = model.eigenvalues / model.trace

    def run(batches):
        for ids, x in _blocks(batches, d):
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), pa.array(model.deviation(x), pa.int64()).take(each),
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("id", "x").mapInArrow(run, schema).withColumnRenamed("id", id_col)
