"""The seasonal stability test against a plain version in trigonometric terms."""

import numpy as np
import pytest

import seriesloom.operators.seasonal_test as st
from helpers import SPEC, noise, series


def plain(y, m):
    """Regress on sines and cosines of all seasonal frequencies; joint statistic of their stability."""
    n = len(y)
    t = np.arange(n)
    cols = []
    for k in range(1, m // 2 + 1):
        cols.append(np.cos(2 * np.pi * k * t / m))
        if 2 * k != m:
            cols.append(np.sin(2 * np.pi * k * t / m))
    f = np.stack(cols, 1)
    x = np.hstack([np.ones((n, 1)), f])
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    g = f * e[:, None]
    width = int(round(m * (n / 100) ** 0.25))
    omega = g.T @ g
    for k in range(1, width + 1):
        c = g[k:].T @ g[:-k] * (1 - k / (width + 1))
        omega += c + c.T
    run = np.cumsum(g, axis=0)
    return np.trace(np.linalg.solve(omega / n, run.T @ run)) / n**2


def drifting(n, m, seed):
    """A seasonal random walk."""
    y = noise(n, seed)
    for i in range(m, n):
        y[i] += y[i - m]
    return y


@pytest.mark.parametrize("m", [7, 12])
def test_stability_equals_numpy(spark, monkeypatch, m):
    t = np.arange(420)
    fixed = 10 * np.sin(2 * np.pi * t / m) + noise(420, 1)
    groups = {"fixed": fixed, "drift": drifting(420, m, 2), "odd": 3 + noise(401, 5, 0.5), "short": list(range(2 * m + 5)), "exact": 2 + np.tile(np.arange(m, dtype=float), 30), "none": [None] * 4,
              "gaps": [None if i % 13 == 2 else v for i, v in enumerate(noise(300, 9))]}
    monkeypatch.setattr(st, "BLOCK_CELLS", 50 * m)  # many blocks per series
    got = {r["grp"]: r for r in st.seasonal_stability(series(spark, groups), SPEC, m).collect()}
    assert set(got) == set(groups) - {"none"}
    for g in ("fixed", "drift", "odd", "gaps"):
        y = np.array([v for v in groups[g] if v is not None])
        assert got[g]["ch_stat"] == pytest.approx(plain(y, m), rel=1e-6) and got[g]["n"] == len(y)
    assert [got[g]["seasonal_d"] for g in ("fixed", "drift", "short", "exact")] == [0, 1, 0, 0]
    assert got["short"]["ch_stat"] == got["exact"]["ch_stat"] == 0.0
    assert {r["sd"] for r in st.seasonal_order(series(spark, groups), SPEC, 1).collect()} == {0}


def test_stability_of_one_series_without_a_group(spark):
    from seriesloom.spec import SeriesSpec

    y = drifting(300, 7, 4)
    one = series(spark, {"a": y}).drop("grp")
    row = st.seasonal_stability(one, SeriesSpec(tie="id"), 7).first()
    assert row["ch_stat"] == pytest.approx(plain(y, 7), rel=1e-6) and row["seasonal_d"] == 1
    assert st.seasonal_stability(one.limit(0), SeriesSpec(tie="id"), 7).count() == 0
