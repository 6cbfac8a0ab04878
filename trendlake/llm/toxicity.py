"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (``sample`` rows of the smallest hashes)
   gives the voters: a seed lexicon, a shouting pattern, and words and word
   beginnings that stand almost only in rows labelled toxic. A voter says
   "toxic" where it fires, one more voter says "clean" where no word fires.
2. A generative label model estimates each voter's firing rate in toxic and in
   clean text by expectation maximisation, and the voters' correlations within
   the classes; a voter counts less the more others repeat it.
3. A linear classifier over hashed word and word-beginning features is trained
   on the posterior labels, and scores every whole text inside tasks.

Labels are read only where ``train`` says so, and only to find voters and the
class share. Null and empty texts have no features and get the bias's score.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.llm import words
from trendlake.llm.tables import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words)

SAMPLE = 8000
BITS = 18
BEGINNINGS = (4, 6)  # code points of word beginnings
TRIM = ".,;:!?&%$#*|\"'()[]{}<>-_"
#: Insults that any list of toxic English words holds.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "filth")
_ROWS = 2000


def hashed(names: list[str], salt: str = "") -> np.ndarray:
    if not names:
        return np.zeros(0, dtype=np.int64)
    values = np.array([salt + n for n in names], dtype=object)
    return (pd.util.hash_array(values, categorize=False) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: pa.Array):
    """For each text its sorted distinct feature numbers: words and their beginnings, by presence."""
    flat, starts = words.split_words(texts)
    coded = pc.utf8_trim(flat, characters=TRIM).dictionary_encode()
    names = coded.dictionary.to_pylist()
    table = np.stack([hashed(names), *[hashed([n[:k] for n in names], f"{k}^") for k in BEGINNINGS]], axis=1)
    index = coded.indices.to_numpy(zero_copy_only=False)
    for a, b in zip(starts[:-1], starts[1:]):
        yield np.unique(table[np.unique(index[a:b])])


@dataclass
class Rows:
    """Sparse 0/1 rows: feature numbers and where each row's start."""

    at: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, lists) -> Rows:
        lists = [np.asarray(x, dtype=np.int64) for x in lists]
        return cls(
            np.concatenate([*lists, np.zeros(0, dtype=np.int64)]),
            np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64),
        )

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.at], minlength=len(self.starts) - 1)

    def turned(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, np.repeat(values, np.diff(self.starts)), minlength=size)


def copy_weights(rows: Rows, hashes: int = 4) -> np.ndarray:
    """One over the size of each row's group of copies, so that repeated texts count as one.

    Rows are grouped by the least hashes of their features under a few permutations.
    """
    n = len(rows.starts) - 1
    key = np.zeros(n, dtype=np.uint64)
    full = np.flatnonzero(np.diff(rows.starts))
    for j in range(hashes):
        scrambled = words.mixed(rows.at.astype(np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        if len(full):
            key[full] = words.mixed(key[full]) + np.minimum.reduceat(scrambled, rows.starts[full])
    _, group, size = np.unique(key, return_inverse=True, return_counts=True)
    return 1 / size[group]


def find_voters(rows: Rows, toxic: np.ndarray, weight: np.ndarray, least: float = 3.5, purity: float = 0.7) -> np.ndarray:
    """Feature numbers of at least ``least`` toxic rows, groups of copies counted once, that stand almost only there."""
    size = 1 << BITS
    bad, all_ = rows.turned(toxic * weight, size), rows.turned(weight, size)
    return np.flatnonzero((bad >= least) & (bad >= purity * (all_ + 0.5)))


def label_model(votes: np.ndarray, share: float, rounds: int = 50, alike_from: float = 0.7) -> np.ndarray:
    """Posterior toxicity of each row from 0/1 votes (rows x voters) and the class share.

    Voters fire independently given the class, up to the correlations found:
    each voter's evidence is divided by its summed absolute correlation,
    inside the classes, with the voters that largely repeat it (itself among
    them; correlations below ``alike_from`` count as independence).
    """
    n, k = votes.shape
    # The last voter is the one for clean text.
    p = np.where(votes[:, :-1].any(axis=1), 0.9, 0.02)
    weight = np.ones(k)
    for step in range(rounds):
        on = (votes * p[:, None]).sum(axis=0) + 0.1
        off = (votes * (1 - p)[:, None]).sum(axis=0) + 0.1
        a = on / (p.sum() + 0.2)
        b = off / ((1 - p).sum() + 0.2)
        if step in (5, 15):
            middle = votes - (p[:, None] * a + (1 - p)[:, None] * b)
            cover = middle.T @ middle / n
            scale = np.sqrt(np.maximum(np.diag(cover), 1e-9))
            alike = np.abs(cover / scale[:, None] / scale[None, :])
            weight = 1 / np.where(alike > alike_from, alike, 0).sum(axis=1).clip(1)
        evidence = votes * np.log(a / b) + (1 - votes) * np.log((1 - a) / (1 - b))
        p = 1 / (1 + np.exp(-np.clip(evidence @ weight + np.log(share / (1 - share)), -30, 30)))
    return p


def fit_logistic(
    rows: Rows, target: np.ndarray, weight: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-4, least: float = 2.5
) -> tuple[np.ndarray, float]:
    """Weights and bias of least weighted cross entropy against soft targets (Adam on all rows, fixed steps).

    Only features are used that stand in at least ``least`` rows and at least
    three times as often in toxic as in other text; plain text is what the
    bias stands for. This keeps the model to words that say something.
    """
    size = 1 << BITS
    high, low = max(float(target @ weight), 1e-9), max(float((1 - target) @ weight), 1e-9)
    inside, outside = rows.turned(target * weight, size), rows.turned((1 - target) * weight, size)
    used = np.flatnonzero((inside + outside >= least) & ((inside + 0.2) / high >= 3 * (outside + 0.2) / low))
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    hit = place[rows.at] >= 0
    row, at = rows.row[hit], place[rows.at[hit]]
    n = len(target)
    w, bias = np.zeros(len(used)), float(np.log(high / low))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    each = weight / weight.sum()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], minlength=n) + bias, -30, 30)))
        g = (p - target) * each
        gw, gb = np.bincount(at, g[row], minlength=len(used)) + decay * w / 10, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = np.maximum(w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8), 0)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights = np.zeros(size)
    weights[used] = w
    return weights, bias


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, lists) -> np.ndarray:
        return np.array([1 / (1 + np.exp(-np.clip(self.weights[x].sum() + self.bias, -30, 30))) for x in lists], dtype=float)


def sampled(labels: DataFrame, id_col: str, label: str, train: Column, sample: int, seed: int = 5) -> DataFrame:
    """At most ``sample`` labelled training rows, those of the smallest hashes, one per id; written."""
    rows = labels.filter(train & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.max(label).cast("double").alias("label")
    )
    return written(rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(sample))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE
) -> Model:
    """The classifier. Without labelled rows of both classes the seeds alone are the voters."""
    chosen = sampled(labels, id_col, label, train, sample)
    got = _features_of(
        docs.select(F.col(id_col), F.col(text).alias("text")).join(F.broadcast(chosen), id_col).select("label", "text")
    ).toPandas()
    rows, gold = Rows.of(got["at"]), got["label"].to_numpy(float)
    weight = copy_weights(rows)
    found = find_voters(rows, gold, weight) if len(gold) else np.zeros(0, dtype=np.int64)
    seeds = hashed(list(SEEDS))
    voters = np.unique(np.concatenate([found, seeds]))
    place = np.full(1 << BITS, -1)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(gold), len(voters) + 2))
    hit = place[rows.at] >= 0
    votes[rows.row[hit], place[rows.at[hit]]] = 1
    votes[:, -2] = got["shouts"].to_numpy(float)
    votes[:, -1] = ~votes[:, :-2].any(axis=1)
    share = float(np.clip(np.average(gold, weights=weight) if len(gold) else 0.05, 0.01, 0.99))
    if len(gold) and votes[:, : len(voters)].any():
        weights, bias = fit_logistic(rows, label_model(votes, share), weight)
    else:
        weights, bias = np.zeros(1 << BITS), -2.0
        weights[seeds] = 4.0
    return Model(weights, bias)


def _features_of(df: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                at = [x.astype(np.int32) for x in features(part.column(1))]
                shouts = [(t or "").count("!") * 100 > len(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(shouts, pa.bool_())], names=["label", "at", "shouts"]
                )

    return df.mapInArrow(run, "label double, at array<int>, shouts boolean")


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, score`` of every row, 0 to 1."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(model.score(features(part.column(1))), pa.float64())], names=["id", "score"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, score double"
    ).withColumnRenamed("id", id_col)
