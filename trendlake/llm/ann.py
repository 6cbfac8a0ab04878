"""Nearest neighbours by multi-index hashing.

A rotation learnt on a bounded sample turns vectors into binary codes. A code
is split into substrings and every substring is indexed. By the pigeonhole
principle a code within Hamming radius r of a query has some substring within
r // substrings bits of the query's, so probing each substring's index to
that depth finds every such code. Those within r are reranked on the original
vectors in double precision. The radius is chosen on the sample so that true
neighbours lie within it.

Vectors are dealt over blocks of bounded size, each with its own index;
queries are dealt over groups and meet every block in a task of their own. A
block answers with its best rows only, and the answers are merged per query.
A query with too few rows within the radius in a block takes that block's
rows from a wider radius, up to all of them, so that answers are never short.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendlake.llm.tables import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
SUBSTRINGS = 4
SAMPLE = 4000
BLOCK = 8192
QUERY_GROUP = 1024
REACH = 0.99  # share of the sample's true neighbours that the radius must hold


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and (dimensions x bits) projection by iterative quantisation.

    Beyond the vectors' dimensions further bits come from random rotations of
    the same principal directions.
    """
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    d = x.shape[1]
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    wide = axes.T[:, : min(bits, axes.shape[0])]
    v = (x - mean) @ wide
    k = wide.shape[1]
    r = np.linalg.qr(rng.normal(size=(k, k)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ vt).T
    out = wide @ r
    while out.shape[1] < bits:
        more = wide @ np.linalg.qr(rng.normal(size=(k, k)))[0]
        out = np.concatenate([out, more], axis=1)[:, :bits]
    return mean, out.reshape(d, bits)


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as unsigned 64-bit numbers."""
    on = ((x - mean) @ projection >= 0).astype(np.uint64)
    return (on << np.arange(projection.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class MultiIndex:
    """Inverted lists of the substrings of 64-bit codes."""

    def __init__(self, codes: np.ndarray, substrings: int = SUBSTRINGS):
        self.codes, self.substrings = codes, substrings
        self.width = BITS // substrings
        self.lists = []
        for j in range(substrings):
            part = self._part(codes, j)
            order = np.argsort(part, kind="stable")
            values, first = np.unique(part[order], return_index=True)
            self.lists.append((values, np.append(first, len(codes)), order))

    def _part(self, codes: np.ndarray, j: int) -> np.ndarray:
        return (codes >> np.uint64(j * self.width)) & np.uint64((1 << self.width) - 1)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of all codes within ``radius`` of ``code``."""
        near = np.zeros(len(self.codes), dtype=bool)
        for j, (values, ends, order) in enumerate(self.lists):
            hit = np.flatnonzero(np.bitwise_count(values ^ self._part(code, j)) <= radius // self.substrings)
            if len(hit) == len(values):
                near[:] = True
                break
            lengths = ends[hit + 1] - ends[hit]
            skip = np.repeat(ends[hit] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            near[order[np.arange(lengths.sum()) + skip]] = True
        at = np.flatnonzero(near)
        return at[np.bitwise_count(self.codes[at] ^ code) <= radius]


def choose_radius(x: np.ndarray, codes: np.ndarray, top: int, reach: float = REACH, queries: int = 200) -> int:
    """The radius that holds ``reach`` of the sample's true neighbours."""
    n = min(queries, len(x))
    score = x[:n] @ x.T
    score[np.arange(n), np.arange(n)] = -np.inf
    k = min(top, len(x) - 1)
    if k < 1:
        return BITS
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return int(np.quantile(np.bitwise_count(codes[best] ^ codes[:n, None]), reach, method="higher"))


def _best(ids: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Positions of the ``top`` best, ties to smaller ids."""
    if len(ids) > top:
        least = np.partition(score, len(score) - top)[len(score) - top]
        keep = np.flatnonzero(score >= least)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -score[keep]))][:top]


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, v``: rows with an id whose vector is not null, not empty, not zero and finite throughout; v is double."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & v.isNotNull()).filter(finite & F.exists(v, lambda x: x != 0.0))
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", top: int = 20,
    sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, the neighbour's id and score for every query: the ``top`` largest inner products found.

    ``queries`` has ids only; a query is not its own neighbour. Unusable
    vectors take no part. All usable vectors must have one length. Of many
    equal vectors only those with the smallest ids can be among the nearest,
    so ``top + 1`` of each are indexed; of repeated rows of an id the least
    vector counts.
    """
    rows = written(usable(vectors, id_col, vector).groupBy("id").agg(F.min("v").alias("v")))
    same = Window.partitionBy("v").orderBy("id")
    indexed = written(rows.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= top + 1).drop("_r"))
    spark = vectors.sparkSession
    fields = f"query_id long, rank int, {id_col} long, score double"
    total = indexed.count()
    if not total:
        return spark.createDataFrame([], fields)
    some = indexed.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    x = np.stack(some["v"].to_numpy())
    mean, projection = learn_rotation(x)
    radius = choose_radius(x, encode(x, mean, projection), top)
    blocks = -(-total // block)
    asked = rows.join(queries.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    groups = max(1, -(-asked.count() // QUERY_GROUP))

    left = indexed.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    right = asked.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("part")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def meet(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(data) or not len(ask):
            return empty
        ids, v = data["id"].to_numpy(), np.stack(data["v"].to_numpy())
        q_ids, q = ask["id"].to_numpy(), np.stack(ask["v"].to_numpy())
        index = MultiIndex(encode(v, mean, projection))
        out = []
        for own, vec, code in zip(q_ids, q, encode(q, mean, projection)):
            reach = radius
            at = index.within(code, reach)
            while len(at) < min(top + 1, len(ids)):
                reach = min(BITS, reach + 8)
                at = index.within(code, reach)
            at = at[ids[at] != own]
            score = v[at] @ vec
            best = _best(ids[at], score, top)
            out.append(pd.DataFrame({"query_id": own, "id": ids[at][best], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(
        meet, "query_id long, id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "query_id", "rank", F.col("id").alias(id_col), "score"
    )
