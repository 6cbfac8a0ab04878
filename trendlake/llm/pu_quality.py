"""Quality classifier by positive-unlabelled learning.

Texts are described by a few structural measures, each cut into bins; the
classifier is linear over the bins. Its weights minimise the non-negative
unbiased risk: with class prior pi, positive rows p and unlabelled rows u,

    pi * E_p[loss(f)] + max(0, E_u[loss(-f)] - pi * E_p[loss(-f)])

on two bounded samples: trusted positives, and rows of the corpus without
their labels. The prior is the share of positives among labelled training
rows. Measuring and scoring run as column expressions over every whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.llm.quality_rules import measure
from trendlake.llm.tables import WHITE, empty_if_null, written
from trendlake.llm.toxicity import sampled

SAMPLE = 6000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Measure -> lower edges of its bins after the first.
EDGES: dict[str, tuple[float, ...]] = {
    "n_words": (1, 5, 10, 20, 35, 50, 100, 300, 1000, 5000),
    "symbols_per_word": (0.01, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0),
    "repeated_share": (0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9),
    "dup_line_share": (0.01, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8),
    "upper_share": (0.01, 0.02, 0.04, 0.07, 0.15, 0.3, 0.6),
    "mark_share": (0.005, 0.01, 0.03, 0.06, 0.1, 0.2),
    "mean_word": (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 14.0),
    "digit_share": (0.01, 0.03, 0.1, 0.3),
}


def described(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and one bin number (from 0) per measure; null text is empty."""
    t = empty_if_null("_text")
    m = measure(df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text")
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.length(t), F.lit(1))

    def share(letters: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, letters, ""))) / chars

    figures = {
        "n_words": F.col("n_words"),
        "symbols_per_word": F.col("n_symbols") / n,
        "repeated_share": F.col("n_repeat_words") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "upper_share": share(UPPER),
        "mark_share": share("!?;:|"),
        "mean_word": F.col("word_chars") / n,
        "digit_share": share("0123456789"),
    }
    m = m.select("_id", *[v.cast("double").alias(k) for k, v in figures.items()])
    return m.select(
        F.col("_id").alias(id_col),
        *[sum(((F.col(k) >= e).cast("int") for e in edges), F.lit(0)).alias(k) for k, edges in EDGES.items()],
    )


def one_hot(bins: np.ndarray) -> np.ndarray:
    """0/1 columns for every bin of every measure."""
    return np.concatenate([np.eye(len(e) + 1)[bins[:, i]] for i, e in enumerate(EDGES.values())], axis=1)


def fit_nonnegative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights, bias last, that minimise the non-negative risk with logistic loss.

    Where the estimate of the negative risk falls below zero, the step goes
    the other way on that part alone, as the method asks.
    """
    positive = np.c_[positive, np.ones(len(positive))]
    unlabelled = np.c_[unlabelled, np.ones(len(unlabelled))]
    w = np.zeros(positive.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    best = w
    for t in range(1, steps + 1):
        sp = 1 / (1 + np.exp(-np.clip(positive @ w, -30, 30)))
        su = 1 / (1 + np.exp(-np.clip(unlabelled @ w, -30, 30)))
        negative = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
        below = unlabelled.T @ su / len(su) - prior * (positive.T @ sp) / len(sp)
        g = prior * (positive.T @ (sp - 1)) / len(sp) + below if negative >= 0 else -below
        g = g + decay * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        best = w if t <= steps - 200 else best + (w - best) / (t - (steps - 200) + 1)
    return best


def fit_quality(
    described_docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE
) -> np.ndarray:
    """Weights from at most ``sample`` positives and ``sample`` corpus rows; ``described_docs`` should be written."""
    names = list(EDGES)
    trusted = sampled(labels.filter(F.col(label) == 1), id_col, label, train, sample)
    positive = described_docs.join(F.broadcast(trusted.select(id_col)), id_col, "left_semi").select(names).limit(2 * sample).toPandas()
    crowd = described_docs.select(*names, F.xxhash64(F.col(id_col), F.lit(29)).alias("h")).orderBy("h", *names).limit(sample).toPandas()
    prior = labels.filter(train & F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    wide = sum(len(e) + 1 for e in EDGES.values())
    if not len(positive) or not len(crowd) or not prior:
        return np.zeros(wide + 1)
    return fit_nonnegative(one_hot(positive[names].to_numpy(int)), one_hot(crowd[names].to_numpy(int)), min(prior, 0.99))


def score_quality(described_docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """``id_col, score`` of every row."""
    total, at = F.lit(float(weights[-1])), 0
    for name, edges in EDGES.items():
        own = F.array(*[F.lit(float(x)) for x in weights[at : at + len(edges) + 1]])
        total = total + F.element_at(own, F.col(name) + 1)
        at += len(edges) + 1
    return described_docs.select(id_col, (1.0 / (1.0 + F.exp(-total))).alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Fit and score: the bins of all rows are written once and read by both."""
    bins = written(described(docs, id_col, text))
    return score_quality(bins, fit_quality(bins, labels, train, id_col, sample=sample), id_col)
