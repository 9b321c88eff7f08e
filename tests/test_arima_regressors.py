"""ARIMA with regressors and with seasonal differences."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SPEC, T0, noise, series
from seriesloom.forecast import arima, baseline
from seriesloom.operators.index import order_series
from seriesloom.spec import SeriesSpec

SMALL = dict(max_p=1, max_q=1, max_sp=1, max_sq=1)


def with_columns(spark, groups, x):
    """Rows (grp, ts, y, id) with regressors x[g] (rows x columns)."""
    rows, k = [], 0
    for g, y in groups.items():
        for i, v in enumerate(y):
            rows.append((g, T0 + dt.timedelta(i), None if v is None else float(v), k, *[None if c is None else float(c) for c in x[g][i]]))
            k += 1
    names = ", ".join(f"x{j} double" for j in range(len(x[g][0])))
    return spark.createDataFrame(rows, f"grp string, ts timestamp_ntz, y double, id bigint, {names}").repartition(3)


def ols(z, y):
    return np.linalg.lstsq(z, y, rcond=None)[0]


def lagged(v, lags, start):
    return np.stack([v[start - k : len(v) - k] for k in lags], 1)


def plain_run(y, x, future):
    """(1,1,0) errors, step by step in numpy."""
    w, dx = np.diff(y), np.diff(x, axis=0)
    one = np.ones((len(w), 1))
    b0 = ols(np.hstack([one, dx]), w)
    u = w - dx @ b0[1:]
    phi = ols(np.hstack([np.ones((len(u) - 10, 1)), lagged(u, range(1, 11), 10)]), u[10:])[1:]
    f = lambda v: v[10:] - sum(p * v[10 - k : len(v) - k] for k, p in enumerate(phi, 1))
    fx = np.stack([f(c) for c in dx.T], 1)
    b1 = ols(np.hstack([np.ones((len(fx), 1)), fx]), f(w))[1:]
    e, r = y - x @ b1, w - dx @ b1
    c, a = ols(np.hstack([np.ones((len(r) - 11, 1)), r[10:-1, None]]), r[11:])
    level, step, out = e[-1], r[-1], []
    for row in future:
        step = c + a * step
        level += step
        out.append(level + row @ b1)
    return b1, out


def test_coefficients_and_forecasts_equal_numpy(spark):
    rng = np.random.default_rng(7)
    n, h = 500, 6
    x = {"a": rng.normal(size=(n, 2)).cumsum(0), "b": np.stack([np.sin(np.arange(n) / 9), rng.normal(size=n)], 1), "tiny": np.ones((3, 2))}
    groups = {"a": 3 * x["a"][:, 0] - 2 * x["a"][:, 1] + noise(n, 1, 0.6).cumsum(), "b": 40 * x["b"][:, 0] + 5 * x["b"][:, 1] + noise(n, 2, 0.3).cumsum(), "tiny": [1.0, 2.0, 4.0]}
    ahead = {g: rng.normal(size=(h, 2)) for g in groups}
    df = with_columns(spark, groups, x)
    grid = baseline.future_dates(df, SPEC, h)
    values = spark.createDataFrame([(g, k + 1, float(a), float(b)) for g, v in ahead.items() for k, (a, b) in enumerate(v)], "grp string, h int, x0 double, x1 double")
    future = grid.join(values, ["grp", "h"]).withColumn("x1", F.when((F.col("grp") == "b") & (F.col("h") == 6), None).otherwise(F.col("x1")))
    cfg = arima.ArimaConfig(auto=False, seasonal=False, p=1, d=1, q=0)
    got = arima.fc_arima(df, SPEC, h, "D", cfg, ["x0", "x1"], future).toPandas().sort_values("h")
    for g, truth in (("a", (3, -2)), ("b", (40, 5))):
        mine = got[got.grp == g]
        beta, path = plain_run(groups[g], x[g], ahead[g])
        np.testing.assert_allclose(mine.coefficients.iloc[0], beta, rtol=1e-6)
        np.testing.assert_allclose(beta, truth, rtol=0.05)
        known = path if g == "a" else path[:5]
        np.testing.assert_allclose(mine.yhat.to_numpy()[: len(known)], known, rtol=1e-6)
    last = got[(got.grp == "b") & (got.h == 6)]
    assert last.yhat.isna().all() and last.hi.isna().all()  # its future value is unknown
    tiny = got[got.grp == "tiny"]
    assert tiny.yhat.tolist() == [4.0] * h and tiny.model_order.isna().all()
    # The scale of a regressor changes nothing.
    scaled = arima.fc_arima(df.withColumn("x0", F.col("x0") * 1000 + 5), SPEC, h, "D", cfg, ["x0", "x1"], future.withColumn("x0", F.col("x0") * 1000 + 5))
    again = scaled.toPandas().sort_values("h")
    np.testing.assert_allclose(again[again.grp == "a"].yhat, got[got.grp == "a"].yhat, rtol=1e-6)


def test_rows_without_a_regressor_are_left_out(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 1))
    y = 4 * x[:, 0] + noise(200, 5)
    holes = [[None] if i % 50 == 7 else r for i, r in enumerate(x)]
    spec = SeriesSpec(tie="id")
    future = spark.createDataFrame([(T0 + dt.timedelta(200), 1.0)], "ts timestamp_ntz, x0 double")
    cfg = arima.ArimaConfig(auto=False, seasonal=False, p=0, d=0, q=0)
    one = arima.fc_arima(with_columns(spark, {"a": y}, {"a": holes}).drop("grp"), spec, 1, "D", cfg, ["x0"], future).first()
    keep = [i for i in range(200) if i % 50 != 7]
    two = arima.fc_arima(with_columns(spark, {"a": y[keep]}, {"a": x[keep]}).drop("grp"), spec, 1, "D", cfg, ["x0"], future.withColumn("ts", F.timestamp_add("DAY", F.lit(-4), "ts"))).first()
    assert one["yhat"] == pytest.approx(two["yhat"]) and one["coefficients"][0] == pytest.approx(4, rel=0.1)
    with pytest.raises(ValueError, match="future"):
        arima.fc_arima(future, spec, 1, regressors=["x0"])


def test_drifting_patterns_are_differenced(spark):
    t = np.arange(350)
    drift = noise(350, 2)
    for i in range(7, 350):
        drift[i] += drift[i - 7]
    fixed = 8 * np.sin(2 * np.pi * t / 7) + noise(350, 4)
    df = series(spark, {"drift": drift, "fixed": fixed})
    cfg = arima.ArimaConfig(**SMALL)
    got = {(r["grp"], r["h"]): r for r in arima.fc_arima(df, SPEC, 7, "D", cfg).collect()}
    order = {g: got[g, 1]["model_order"] for g in ("drift", "fixed")}
    parts = {g: [int(v) for v in o.replace(")(", ",").strip("()").split(",")] for g, o in order.items()}
    assert parts["drift"][4] == 1 and parts["fixed"][4] == 0
    np.testing.assert_allclose([got["drift", h]["yhat"] for h in range(1, 8)], drift[-7:], atol=4)  # the last week repeats
    rows = order_series(df, SPEC).indexed()
    off = {r["grp"]: (r["d"], r["sd"]) for r in arima.difference_orders(rows, SPEC, arima.ArimaConfig(max_sd=0, max_d=0), 7).collect()}
    assert off == {"drift": (0, 0), "fixed": (0, 0)}
