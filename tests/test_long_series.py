"""Rolling figures and interpolation over stretches equal those over whole series."""

import numpy as np
import pandas as pd
import pytest

from trendlake.operators import series


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(12)
    rows = []
    for g, n in (("hot", 230), (None, 31), ("b", 1), ("c", 40)):
        for i in range(n):
            gap = rng.random() < 0.3 or (g == "hot" and 40 < i < 120) or (g == "c" and i > 20)
            rows.append((g, i, None if gap else float(rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, "g string, t int, v double, u double")


def frames(df, name):
    """Per series the column in order of time."""
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], []).append((r["t"], r[name]))
    return {g: [np.nan if v is None else v for _, v in sorted(x)] for g, x in out.items()}


@pytest.mark.parametrize("stretch", [7, 1 << 16])
def test_rolling_figures(spark, lines, monkeypatch, stretch):
    monkeypatch.setattr(series, "STRETCH", stretch)
    value, other = frames(lines, "v"), frames(lines, "u")
    mean = frames(series.rolling_mean(lines, "t", "v", 20, 3, by=["g"]), "rolling")
    corr = frames(series.rolling_corr(lines, "t", "v", "u", 9, 4, by=["g"]), "rolling_r")
    near = frames(series.median_filter(lines, "t", "v", 12, 1.5, by=["g"]), "v")
    for g, v in value.items():
        s, u = pd.Series(v), pd.Series(other[g])
        for i in range(len(s)):
            part = s.iloc[max(0, i - 10) : i + 10].dropna()
            assert mean[g][i] == pytest.approx(part.mean() if len(part) >= 3 else np.nan, nan_ok=True)
            a, b = s.iloc[max(0, i - 4) : i + 5], u.iloc[max(0, i - 4) : i + 5]
            ok = a.notna()
            assert corr[g][i] == pytest.approx(np.corrcoef(a[ok], b[ok])[0, 1] if ok.sum() >= 4 else np.nan, nan_ok=True)
            w = s.iloc[max(0, i - 6) : i + 6].dropna()
            away = len(w) > 1 and abs(v[i] - w.median()) > 1.5 * w.std()
            assert near[g][i] == pytest.approx(np.nan if away else v[i], nan_ok=True)


@pytest.mark.parametrize("stretch", [7, 1 << 16])
def test_interpolation(spark, lines, monkeypatch, stretch):
    monkeypatch.setattr(series, "STRETCH", stretch)
    got = frames(series.interpolate(lines, "t", "v", by=["g"]), "v")
    for g, v in frames(lines, "v").items():
        assert got[g] == pytest.approx(pd.Series(v).interpolate(limit_direction="forward").tolist(), nan_ok=True)
    whole = series.interpolate(lines.filter("g = 'hot'"), "t", "v", name="w")
    assert frames(whole, "w")["hot"] == pytest.approx(got["hot"], nan_ok=True) and "v" in whole.columns
