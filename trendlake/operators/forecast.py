"""Seasonal-intervention regression: trend, cycles, event windows, steps, ramps and outside regressors.

Design columns are expressions over ``ds``. Tasks add up the moments of the
standardised columns, and the normal equations over the terms, whose number
the design bounds, are solved once. Every part may have its own penalty, on
squares or on absolute values: the latter is met by coordinate descent on the
same moments and leaves few changepoints. Intervals come from the residual
variance and the inverse of the penalised equations, or from draws of future
slope changes, which widen with the horizon. The multiplicative form fits
log(1 + y); back-transformed values estimate the median rather than the mean.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.functions.terms import bin_labels, days_since_epoch, fourier_terms, ramp_from, step_from
from trendlake.operators.series import accuracy, attach_regressors, event_windows
from trendlake.operators.trends import innovation_levels
from trendlake.session import materialise, side_by_side
from trendlake.sources.files import hash_split


@dataclass(frozen=True)
class Design:
    """What goes into the model besides intercept and linear trend."""

    cycles: tuple[tuple[str, float, int], ...] = ()  # name, period in days, order
    event_years: tuple[int, ...] = ()  # step and ramp from 1 January of each
    ramps: bool = True
    regressors: tuple[str, ...] = ()
    holidays: tuple[str, ...] = ()  # names in the calendar
    holiday_window: tuple[int, int] = (-2, 2)
    holiday_windows: tuple[tuple[str, int, int], ...] = ()  # name, first and last day of holidays with a window of their own
    changepoints: int = 0  # hinges over the first 80% of the training range
    multiplicative: bool = False
    ridge: float = 0.0  # penalty of every term that penalties does not name
    #: Part or term name and its penalty. Days of neighbouring holidays may coincide, so they have a slight one.
    penalties: tuple[tuple[str, float], ...] = (("holidays", 1e-6),)

    #: Part or term name and the weight of its absolute coefficient, in deviations of the term, next to half the mean
    #: squared error. ``changepoints`` names all hinges.
    sparse: tuple[tuple[str, float], ...] = ()

    def sparsity(self, term: str, part: str) -> float:
        own = dict(self.sparse)
        hinges = own.get("changepoints") if term.startswith("hinge_") else None
        return own.get(term, own.get(part, 0.0) if hinges is None else hinges)

    def penalty(self, term: str, part: str) -> float:
        """The weight of a term's squared coefficient, in deviations of the term, next to the mean squared error."""
        own = dict(self.penalties)
        return own.get(term, own.get(part, self.ridge))


@dataclass
class Fitted:
    design: Design
    span: tuple[float, float]
    columns: list[str]
    parts: dict[str, str]
    intercept: float
    coefficients: list[float]
    errors: list[float]  # of the coefficients, then the intercept
    sigma: float
    calendar: DataFrame | None = None
    level: float = 0.8
    extra: dict = field(default_factory=dict)

    def _linear(self) -> Column:
        out = F.lit(self.intercept)
        for name, c in zip(self.columns, self.coefficients):
            out = out + F.col(f"`{name}`") * F.lit(c)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """``ds, yhat, yhat_lower, yhat_upper`` for frames with ``ds`` and the regressors."""
        rows, _ = design_columns(df, self.design, self.span, self.calendar)
        reach = NormalDist().inv_cdf(0.5 + self.level / 2.0) * self.sigma
        back = F.expm1 if self.design.multiplicative else (lambda c: c)
        line = self._linear()
        return rows.select(
            "ds", back(line).alias("yhat"), back(line - F.lit(reach)).alias("yhat_lower"),
            back(line + F.lit(reach)).alias("yhat_upper"),
        )

    def slope_changes(self) -> tuple[float, float]:
        """How many changes of slope a day of history has, and their mean size (per scaled time)."""
        sizes = [abs(c) for n, c in zip(self.columns, self.coefficients) if n.startswith("hinge_")]
        days = (self.span[1] - self.span[0]) or 1.0
        return self.design.changepoints / days, sum(sizes) / max(self.design.changepoints, 1)

    def draws(self, df: DataFrame, draws: int = 200, seed: int = 1) -> DataFrame:
        """``ds, draw, error``: what the days of ``df`` may differ from the fitted line by, in every draw.

        A day after training changes the slope with the frequency and the mean
        size that history shows (Laplace), and its change lasts; every day has
        the residual's noise. All chances are hashes of seed, draw and day, so
        they repeat. A draw is one series, as long as the calendar.
        """
        rate, size = self.slope_changes()
        days = df.select(F.col("ds").cast("date").alias("ds")).filter("ds is not null").distinct()
        rows = days.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))

        def chance(name: str) -> Column:
            text = F.concat_ws("|", F.lit(seed), "draw", F.date_format("ds", "yyyy-MM-dd"), F.lit(name))
            return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)

        t, side = _scaled_time(self.span), chance("size") - 0.5
        laplace = -F.lit(size) * F.signum(side) * F.ln(F.greatest(1.0 - 2.0 * F.abs(side), F.lit(1e-16)))
        changes = (days_since_epoch("ds") > F.lit(self.span[1])) & (chance("change") < F.lit(rate))
        rows = rows.withColumn("t", t).withColumn("d", F.when(changes, laplace).otherwise(0.0))
        so_far = Window.partitionBy("draw").orderBy("ds")
        drift = F.col("t") * F.sum("d").over(so_far) - F.sum(F.col("d") * F.col("t")).over(so_far)
        noise = F.lit(self.sigma) * F.sqrt(-2.0 * F.ln(1.0 - chance("noise"))) * F.cos(chance("angle") * (2.0 * math.pi))
        return rows.select("ds", "draw", (drift + noise).alias("error"))

    def predict_by_draws(self, df: DataFrame, draws: int = 200, seed: int = 1) -> DataFrame:
        """``ds, yhat, yhat_lower, yhat_upper`` with exact quantiles of the draws as limits."""
        low, high = 0.5 - self.level / 2.0, 0.5 + self.level / 2.0
        limits = self.draws(df, draws, seed).groupBy("ds").agg(F.percentile("error", F.array(F.lit(low), F.lit(high))).alias("q"))
        rows, _ = design_columns(df.withColumn("ds", F.col("ds").cast("date")), self.design, self.span, self.calendar)
        back = F.expm1 if self.design.multiplicative else (lambda c: c)
        line = rows.select("ds", self._linear().alias("line")).join(materialise(limits), "ds", "left")
        return line.select(
            "ds", back(F.col("line")).alias("yhat"), back(F.col("line") + F.get("q", F.lit(0))).alias("yhat_lower"),
            back(F.col("line") + F.get("q", F.lit(1))).alias("yhat_upper"),
        )

    def components(self, df: DataFrame) -> DataFrame:
        """``ds`` and one column per part: trend, each cycle, holidays, each intervention and regressor.

        The parts add up to the fitted value (of log(1 + y) in the multiplicative form).
        """
        rows, _ = design_columns(df, self.design, self.span, self.calendar)
        sums: dict[str, Column] = {"trend": F.lit(self.intercept)}
        for name, c in zip(self.columns, self.coefficients):
            part = self.parts[name]
            sums[part] = sums.get(part, F.lit(0.0)) + F.col(f"`{name}`") * F.lit(c)
        return rows.select("ds", *[v.alias(k) for k, v in sums.items()])

    def coefficient_table(self, spark, names: Sequence[str] | None = None) -> DataFrame:
        """``term, coefficient, lower, upper``: 95% intervals, for penalised terms those of a normal prior of that weight."""
        terms = [("intercept", self.intercept), *zip(self.columns, self.coefficients)]
        errors = [self.errors[-1], *self.errors[:-1]]
        rows = [
            (n, float(c), float(c - 1.96 * e), float(c + 1.96 * e))
            for (n, c), e in zip(terms, errors) if names is None or n in names
        ]
        return spark.createDataFrame(rows, "term string, coefficient double, lower double, upper double")


def _scaled_time(span: tuple[float, float]) -> Column:
    low, high = span
    return (days_since_epoch("ds") - F.lit(low)) / F.lit((high - low) or 1.0)


def design_columns(
    df: DataFrame, design: Design, span: tuple[float, float], calendar: DataFrame | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with one column per term, and the part each term belongs to."""
    t = _scaled_time(span)
    named: dict[str, Column] = {"trend": t}
    parts = {"trend": "trend"}
    for j in range(design.changepoints):
        at = 0.8 * (j + 1) / design.changepoints
        named[f"hinge_{j + 1}"] = F.greatest(t - F.lit(at), F.lit(0.0))
        parts[f"hinge_{j + 1}"] = "trend"
    for name, period, order in design.cycles:
        labels = [f"{name}_{f}{k}" for k in range(1, order + 1) for f in ("sin", "cos")]
        for label, term in zip(labels, fourier_terms("ds", period, order, name)):
            named[label] = term
            parts[label] = name
    for year in design.event_years:
        named[f"step_{year}"] = step_from("ds", year)
        parts[f"step_{year}"] = f"step_{year}"
        if design.ramps:
            named[f"ramp_{year}"] = ramp_from("ds", year)
            parts[f"ramp_{year}"] = f"ramp_{year}"
    for name in design.regressors:
        parts[name] = name
    out = df.withColumns(named)
    if design.holidays and calendar is not None:
        windows = {h: design.holiday_window for h in design.holidays}
        windows |= {h: (a, b) for h, a, b in design.holiday_windows if h in windows}
        low, high = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
        flags = {
            f"holiday_{h}_{k}": F.max(F.when((F.col("holiday") == h) & (F.col("day") == k), 1.0).otherwise(0.0))
            for h, (a, b) in windows.items() for k in range(a, b + 1)
        }
        days = event_windows(calendar, low, high).groupBy("ds").agg(*[v.alias(k) for k, v in flags.items()])
        out = out.join(days, "ds", "left").na.fill(0.0, list(flags))
        parts.update({k: "holidays" for k in flags})
    return out, parts


def _moments(rows: DataFrame, columns: Sequence[str], centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sums of products of the standardised ``columns``, added up inside tasks first."""
    k = len(columns)

    def run(frames):
        total = np.zeros((k, k))
        for frame in frames:
            x = (frame.to_numpy(float) - centre) / scale
            total += x.T @ x
        yield pd.DataFrame({"at": np.arange(k * k), "v": total.ravel()})

    picked = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sums = picked.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    # one row of k * k numbers, whose count the design bounds
    all_sums = sums.agg(F.array_sort(F.collect_list(F.struct("at", "v")))["v"].alias("v")).first()["v"]
    return np.array(all_sums if all_sums else np.zeros(k * k)).reshape(k, k)


def _dependent(c: np.ndarray, least: float = 1e-9) -> list[int]:
    """Places of standardised terms of which less than ``least`` is left beside the terms before them."""
    kept: list[int] = []
    out = []
    for j in range(len(c)):
        left = c[j, j] - (c[j, kept] @ np.linalg.solve(c[np.ix_(kept, kept)], c[kept, j]) if kept else 0.0)
        (kept if left > least else out).append(j)
    return out


def coordinate_descent(c: np.ndarray, xy: np.ndarray, squares: np.ndarray, sizes: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """The least of ``b'cb / 2 - b'xy + sum(squares * b ** 2) / 2 + sum(sizes * |b|)``, one coefficient after the other.

    The moments hold all that is needed of the rows, so a sweep costs the
    square of the number of terms.
    """
    b = np.zeros(len(xy))
    gradient = xy.astype(float).copy()  # xy - c b
    for _ in range(100_000):
        most = 0.0
        for j in range(len(b)):
            pull = gradient[j] + c[j, j] * b[j]
            new = math.copysign(max(abs(pull) - sizes[j], 0.0), pull) / (c[j, j] + squares[j])
            if new != b[j]:
                gradient -= c[:, j] * (new - b[j])
                most = max(most, abs(new - b[j]))
                b[j] = new
        if most <= tolerance * max(1.0, np.abs(b).max(initial=0.0)):
            break
    return b


def fit(train: DataFrame, design: Design, calendar: DataFrame | None = None, level: float = 0.8) -> Fitted:
    """Fit on rows with ``ds, y`` and the regressors. Terms that never vary in training are left out.

    Terms without a penalty that depend linearly on one another have no
    single answer: they are named in an error.
    """
    # A series is short but may be the sum of a very large table: computed once.
    train = materialise(train)
    day = days_since_epoch("ds")
    ends = train.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    if ends["a"] is None:
        raise ValueError("no dated row to fit on")
    span = (float(ends["a"]), float(ends["b"]))
    rows, parts = design_columns(train.filter(F.col("y").isNotNull()), design, span, calendar)
    rows = rows.withColumn("_y", F.log1p("y") if design.multiplicative else F.col("y").cast("double"))
    rows = rows.dropna(subset=[*parts, "_y"])
    names = [*parts, "_y"]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(F.avg(f"`{n}`").alias("m"), F.stddev_pop(f"`{n}`").alias("s"), (F.max(f"`{n}`") > F.min(f"`{n}`")).alias("v")).alias(f"s{i}")
        for i, n in enumerate(names)
    ]).first()
    if not seen["n"]:
        raise ValueError("no row has y and all regressors")
    stats = {n: seen[f"s{i}"] for i, n in enumerate(names)}
    columns = [n for n in parts if stats[n]["v"] and stats[n]["s"] > 0]
    n, k = int(seen["n"]), len(columns)
    mean = np.array([stats[c]["m"] for c in [*columns, "_y"]], dtype=float)
    scale = np.array([stats[c]["s"] for c in columns] + [1.0], dtype=float)
    m = _moments(rows, [*columns, "_y"], mean, scale) / n
    c, xy, yy = m[:k, :k], m[:k, k], m[k, k]
    weights = np.array([design.penalty(t, parts[t]) for t in columns])
    sizes = np.array([design.sparsity(t, parts[t]) for t in columns])
    free_terms = np.flatnonzero((weights == 0.0) & (sizes == 0.0))
    tied = [columns[free_terms[j]] for j in _dependent(c[np.ix_(free_terms, free_terms)])]
    if tied:
        raise ValueError(f"terms depend linearly on others; leave them out or give them a penalty: {', '.join(tied)}")
    if sizes.any():
        # errors are those of a fit of the terms that are left
        beta = coordinate_descent(c, xy, weights, sizes)
        live = np.flatnonzero((beta != 0.0) | (sizes == 0.0))
        inverse = np.zeros((k, k))
        inverse[np.ix_(live, live)] = np.linalg.pinv(c[np.ix_(live, live)] + np.diag(weights[live]))
    else:
        inverse = np.linalg.inv(c + np.diag(weights)) if k else np.zeros((0, 0))
        beta = inverse @ xy
    free = max(n - 1 - float(np.trace(c @ inverse)), 1.0)
    sigma = math.sqrt(max(float(yy - 2 * beta @ xy + beta @ c @ beta), 0.0) * n / free)
    spread = inverse / np.outer(scale[:k], scale[:k]) * (sigma * sigma / n)
    beta = beta / scale[:k]
    own = math.sqrt(sigma * sigma / n + float(mean[:k] @ spread @ mean[:k]))
    return Fitted(
        design, span, columns, {t: parts[t] for t in columns}, float(mean[k] - beta @ mean[:k]), [float(b) for b in beta],
        [*(float(e) for e in np.sqrt(np.diag(spread))), own], sigma, calendar, level,
    )


def future_frame(history: DataFrame, periods: int, freq: str = "day", with_history: bool = True) -> DataFrame:
    """``ds`` after the last observed one, with the history in front unless told otherwise."""
    if freq not in ("day", "year"):
        raise ValueError("freq is 'day' or 'year'")
    last = history.agg(F.max(F.col("ds").cast("date")).alias("last"))
    step = F.explode(F.sequence(F.lit(1), F.lit(max(periods, 1))))
    ahead = last.select("last", step.alias("k")).filter(F.col("k") <= periods)
    moved = F.date_add("last", F.col("k")) if freq == "day" else F.add_months("last", F.col("k") * 12)
    future = ahead.select(moved.alias("ds"))
    return history.select(F.col("ds").cast("date").alias("ds")).union(future) if with_history else future


def forecast_with_regressors(
    fitted: Fitted, history: DataFrame, periods: int, regressors: Sequence[DataFrame], freq: str = "day"
) -> DataFrame:
    """Predictions for history and future days; days without a regressor value have no prediction."""
    return fitted.predict(attach_regressors(future_frame(history, periods, freq), regressors))


def fit_levels(levels: DataFrame, edges: Sequence[float], design: Design, calendar: DataFrame | None = None) -> dict[str, Fitted]:
    """One model per distance bin of a yearly level table."""
    levels = materialise(levels)
    labels = [label for _, _, label in bin_labels(edges)]
    models = side_by_side(levels.sparkSession, lambda label: fit(level_series(levels, label), design, calendar), labels)
    return dict(zip(labels, models))


def level_series(levels: DataFrame, label: str) -> DataFrame:
    """``ds`` (1 January) and ``y`` of one bin."""
    return levels.select(
        F.make_date("year", F.lit(1), F.lit(1)).alias("ds"), F.col(f"`{label}`").cast("double").alias("y")
    )


def level_coefficients(models: dict[str, Fitted], spark, names: Sequence[str] | None = None) -> DataFrame:
    """``range, term, coefficient, lower, upper`` over all bins."""
    out = None
    for label, m in models.items():
        t = m.coefficient_table(spark, names).select(F.lit(label).alias("range"), "*")
        out = t if out is None else out.union(t)
    return out


def half_split_replication(
    df: DataFrame, keys: Sequence[str], score, edges: Sequence[float], design: Design, dims: int | None = 2,
    year: str = "year", distance: str = "internal", seed: int = 42,
) -> DataFrame:
    """``range, r, r2, mae, n``: models fitted on one half of the rows, checked against the other half's counts."""
    a, b = hash_split(df, keys, 0.5, seed)
    first, second = (innovation_levels(half, score, edges, distance, dims, year) for half in (a, b))
    second = materialise(second)
    out = None
    for label, m in fit_levels(first, edges, design).items():
        seen = level_series(second, label)
        row = accuracy(m.predict(seen).join(seen, "ds")).select(F.lit(label).alias("range"), "*")
        out = row if out is None else out.union(row)
    return out
