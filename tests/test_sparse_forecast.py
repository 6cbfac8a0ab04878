"""Sparse changepoints and drawn intervals against slow versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlake.operators import forecast


def proximal(x, y, squares, sizes):
    """Gradient steps on the rows, each followed by soft thresholds."""
    n = len(x)
    step = 1.0 / (np.linalg.eigvalsh(x.T @ x / n).max() + squares.max())
    b = np.zeros(x.shape[1])
    for _ in range(60_000):
        b = b - step * (x.T @ (x @ b - y) / n + squares * b)
        b = np.sign(b) * np.maximum(np.abs(b) - step * sizes, 0.0)
    return b


def test_coordinate_descent_equals_proximal_gradient():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) @ (np.eye(6) + 0.4 * rng.normal(size=(6, 6)))
    y = x @ np.array([2.0, 0.0, -1.0, 0.0, 0.05, 0.0]) + rng.normal(size=300)
    for squares, sizes in ((np.zeros(6), np.full(6, 0.2)), (np.full(6, 0.1), np.array([0.0, 0.3, 0.0, 1.0, 0.1, 50.0]))):
        got = forecast.coordinate_descent(x.T @ x / 300, x.T @ y / 300, squares, sizes)
        want = proximal(x, y, squares, sizes)
        assert got == pytest.approx(want, abs=1e-8) and ((got == 0.0) == (np.abs(want) < 1e-9)).all()


@pytest.fixture(scope="module")
def bent(spark):
    rng = np.random.default_rng(1)
    first = dt.date(2001, 1, 1)
    rows = [(first + dt.timedelta(days=i), 0.01 * i + (0.05 * (i - 200) if i > 200 else 0.0) + float(rng.normal(0, 0.3))) for i in range(500)]
    return spark.createDataFrame(rows, "ds date, y double")


def test_few_changepoints_are_left(bent):
    free = forecast.fit(bent, forecast.Design(changepoints=20, ridge=1e-9))
    few = forecast.fit(bent, forecast.Design(changepoints=20, sparse=(("changepoints", 0.05),)))
    hinges = {n: c for n, c in zip(few.columns, few.coefficients) if n.startswith("hinge_")}
    assert 1 <= sum(c != 0.0 for c in hinges.values()) <= 6 < sum(c != 0.0 for c in free.coefficients)
    assert max(hinges, key=lambda n: abs(hinges[n])) in ("hinge_9", "hinge_10", "hinge_11")
    assert few.sigma < 0.5 and all(e == 0.0 for n, c, e in zip(few.columns, few.coefficients, few.errors) if c == 0.0)
    none = forecast.fit(bent, forecast.Design(changepoints=20, sparse=(("hinge_3", 0.05), ("changepoints", 1e6))))
    assert [n for n, c in zip(none.columns, none.coefficients) if n.startswith("hinge_") and c] in ([], ["hinge_3"])


def test_drawn_intervals_widen_and_repeat(bent):
    fitted = forecast.fit(bent, forecast.Design(changepoints=20, ridge=1e-3))
    ahead = forecast.future_frame(bent, 400)
    one, two = (fitted.predict_by_draws(ahead, 150, seed=3).orderBy("ds").collect() for _ in range(2))
    assert one == two and len(one) == 900
    width = np.array([r["yhat_upper"] - r["yhat_lower"] for r in one])
    past, near, far = width[:500].mean(), width[500:560].mean(), width[-60:].mean()
    assert past == pytest.approx(2 * 1.2816 * fitted.sigma, rel=0.1) and far > 1.5 * near > 1.2 * past
    assert fitted.predict_by_draws(ahead, 150, seed=4).orderBy("ds").collect() != one
    line = fitted.predict(ahead).orderBy("ds").collect()
    assert [r["yhat"] for r in line] == pytest.approx([r["yhat"] for r in one])


def test_days_without_a_date_have_no_interval(bent):
    fitted = forecast.fit(bent, forecast.Design(changepoints=2))
    days = bent.select("ds").limit(3).union(bent.select(F.lit(None).cast("date").alias("ds")).limit(1))
    out = fitted.predict_by_draws(days, 20).collect()
    assert len(out) == 4 and sum(r["yhat_lower"] is None for r in out) == 1
