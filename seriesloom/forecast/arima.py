"""Seasonal ARIMA by the two regressions of Hannan and Rissanen (1982).

A long autoregression gives the innovations; then the series is regressed on its own
lags and on lagged innovations. Both regressions are sums formed by Spark in padded
blocks. All candidate orders are sub-blocks of one matrix per series, so the order
search touches reduced rows only. Seasonal terms enter additively at lags m, 2m.
With regressors the series is a regression whose errors follow such a model: the
coefficients come from differenced rows, first plainly, then weighted by an
autoregression of the residuals, and the errors are modelled as above.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.functions.linalg import gram, least_squares, square
from seriesloom.operators.clean import add_steps
from seriesloom.operators.index import IDX, LEN, OWN, BLK, block_window, halo_blocks, order_series
from seriesloom.operators.joins import attach, number_or_null, series_join, side_join
from seriesloom.operators.profile import present
from seriesloom.operators.seasonal_test import seasonal_order
from seriesloom.operators.stationarity import stationarity_kpss
from seriesloom.functions.features import diff_regular
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec

#: Seasonal period by frequency code.
ARIMA_PERIODS = {"H": 24, "D": 7, "W": 52, "M": 12}


@dataclass(frozen=True)
class ArimaConfig:
    """With ``auto`` the ``max_*`` bound an AIC search; else the given orders are used."""

    auto: bool = True
    seasonal: bool = True
    period: int | None = None
    max_p: int = 5
    max_q: int = 5
    max_d: int = 2
    max_sp: int = 2
    max_sq: int = 2
    max_sd: int = 1
    p: int = 1
    d: int = 1
    q: int = 1
    sp: int = 1
    sd: int = 1
    sq: int = 1
    level: float = 0.95

    def m(self, freq: str) -> int:
        return (self.period or ARIMA_PERIODS.get(freq, 7)) if self.seasonal else 1


def field_of(array: str, name: str):
    """One field of every struct in an array."""
    return F.transform(array, lambda s: s[name])


def _candidates(cfg: ArimaConfig) -> list[tuple[int, int, int, int]]:
    if not cfg.auto:
        return [(cfg.p, cfg.q, cfg.sp if cfg.seasonal else 0, cfg.sq if cfg.seasonal else 0)]
    sp = range(cfg.max_sp + 1) if cfg.seasonal else [0]
    sq = range(cfg.max_sq + 1) if cfg.seasonal else [0]
    return [(p, q, a, b) for p in range(cfg.max_p + 1) for q in range(cfg.max_q + 1) for a in sp for b in sq]


def difference_order(df: DataFrame, spec: SeriesSpec, max_d: int = 2) -> DataFrame:
    """Fewest differences after which the KPSS test does not reject level stationarity."""
    order = None
    current, cspec = present(df, spec).select(*spec.by, spec.ts, *spec.tie, F.col(spec.y).cast("double").alias("_y0")), spec.with_target("_y0")
    for d in range(max_d):
        test = stationarity_kpss(current, cspec).select(*spec.by, F.when(F.col("kpss_stationary"), d).alias(f"_d{d}"))
        order = test if order is None else series_join(order, test, spec.by)
        if d + 1 < max_d:
            step = diff_regular(current, cspec).select(*spec.by, spec.ts, *spec.tie, F.col(f"{cspec.y}_diff_1").alias(f"_y{d + 1}"))
            current, cspec = materialize(present(step, cspec.with_target(f"_y{d + 1}"))), cspec.with_target(f"_y{d + 1}")
    return materialize(order.select(*spec.by, F.coalesce(*[f"_d{d}" for d in range(max_d)], F.lit(max_d)).alias("d")))


def regress(gram_column: str, n_column: str) -> Column:
    """Coefficients of the last column of a matrix of sums on the others, or NULL where there are too few rows."""
    @F.pandas_udf("array<double>")
    def solve(flat: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for v, rows_n in zip(flat, n):
            g = square(v)
            k = g.shape[0] - 1
            out.append(least_squares(g, range(k), k)[0].tolist() if rows_n > k + 2 else None)
        return pd.Series(out)

    return solve(gram_column, n_column)


def _differenced(column: str, window, m: int, seasonal: bool) -> Column:
    """(1-B)^d (1-B^m)^sd of a column, with d and sd from the row's own columns."""
    def lagged(k: int):
        return F.lag(column, k).over(window) if k else F.col(column)

    def diff(at: int):
        y0, y1, y2 = lagged(at), lagged(at + 1), lagged(at + 2)
        return F.when(F.col("d") == 0, y0).when(F.col("d") == 1, y0 - y1).otherwise(y0 - 2 * y1 + y2)

    return F.when(F.col("sd") == 1, diff(0) - diff(m)).otherwise(diff(0)) if seasonal else diff(0)


def _less(column: str, regressors: Sequence[str], beta: str, offset: int = 2) -> Column:
    """A column less the effect of the regressors; ``beta`` holds a constant first."""
    return F.col(column) - sum((F.element_at(beta, k + offset) * F.col(x) for k, x in enumerate(regressors)), F.lit(0.0))


def difference_orders(rows: DataFrame, spec: SeriesSpec, cfg: ArimaConfig, m: int) -> DataFrame:
    """Orders (d, sd) of each series: first whether its seasonal pattern drifts, then the KPSS test on what seasonal differences leave."""
    seasonal = cfg.seasonal and cfg.max_sd > 0 and m > 1
    if seasonal:
        order = seasonal_order(rows, spec, m)
        both = attach(rows, order, spec.by)
        blocks = halo_blocks(both, back=m)
        step = F.when(F.col("sd") == 1, F.col(spec.y) - F.lag(spec.y, m).over(block_window(spec.by))).otherwise(F.col(spec.y))
        rows = blocks.withColumn("_sy", step).filter(F.col(OWN) & F.col("_sy").isNotNull()).drop(BLK, OWN, IDX, LEN, spec.y).withColumnRenamed("_sy", spec.y)
        rows = materialize(rows)
    if cfg.max_d > 0:
        found = difference_order(rows, spec, cfg.max_d)
    else:
        found = rows.select(*spec.by).distinct().withColumn("d", F.lit(0)) if spec.by else rows.sparkSession.range(1).select(F.lit(0).alias("d"))
    return materialize(series_join(found, order, spec.by) if seasonal else found.withColumn("sd", F.lit(0)))


def regression_coefficients(steps: DataFrame, spec: SeriesSpec, regressors: Sequence[str], m: int, seasonal: bool) -> DataFrame:
    """Per series the array (constant, one coefficient per regressor) ``_beta`` of a regression of the differenced target ``_w`` on differenced regressors.

    Feasible generalised least squares: plain coefficients, an autoregression of the residuals at lags 1 to 10, m and 2m, and the regression of the filtered columns.
    Each step is one small matrix of sums per series. Series too short for the weights keep the plain coefficients, shorter ones 0.
    """
    names = [f"_x{k}" for k in range(len(regressors))]
    one = F.lit(1.0).alias("_one")
    plain = gram(steps.filter(F.col(IDX) >= F.col("_s")).select(*spec.by, one, *names, "_w"), spec.by, ["_one", *names, "_w"])
    plain = materialize(plain.select(*spec.by, regress("gram", "n").alias("_b0")))
    steps = attach(steps, plain, spec.by).withColumn("_u", _less("_w", names, "_b0"))
    lags = list(dict.fromkeys([*range(1, 11), *([m, 2 * m] if seasonal else [])]))
    w = block_window(spec.by)
    blocks = halo_blocks(steps, back=max(lags))
    past = blocks.select("*", *[F.lag("_u", k).over(w).alias(f"_u{k}") for k in lags]).filter(F.col(OWN)).drop(BLK, OWN)
    full = F.col(IDX) >= F.col("_s") + max(lags)
    weights = gram(past.filter(full).select(*spec.by, one, *[f"_u{k}" for k in lags], "_u"), spec.by, ["_one", *[f"_u{k}" for k in lags], "_u"])
    weights = materialize(weights.select(*spec.by, regress("gram", "n").alias("_phi")))
    blocks = halo_blocks(attach(steps.drop("_u"), weights, spec.by), back=max(lags))
    filtered = {
        c: sum((-F.element_at("_phi", i + 2) * F.lag(c, k).over(w) for i, k in enumerate(lags)), F.col(c)).alias(c) for c in [*names, "_w"]
    }
    ready = blocks.select(*spec.by, OWN, IDX, "_s", *filtered.values()).filter(F.col(OWN) & full & F.col("_w").isNotNull())
    better = gram(ready.select(*spec.by, one, *names, "_w"), spec.by, ["_one", *names, "_w"])
    better = better.select(*spec.by, regress("gram", "n").alias("_b1"))
    zeros = F.array(*[F.lit(0.0)] * (len(names) + 1))
    return materialize(series_join(plain, better, spec.by).select(*spec.by, F.coalesce("_b1", "_b0", zeros).alias("_beta")))


def fc_arima(df: DataFrame, spec: SeriesSpec, horizon: int = 30, freq: str = "D", cfg: ArimaConfig = ArimaConfig(),
             regressors: Sequence[str] = (), future: DataFrame | None = None) -> DataFrame:
    """Fit on ``df`` and forecast (see ``fit_arima`` and ``predict_arima``)."""
    if list(regressors) and future is None:
        raise ValueError("regressors need their future values")
    return predict_arima(fit_arima(df, spec, freq, cfg, regressors), spec, horizon, freq, cfg, regressors, future)


def fit_arima(df: DataFrame, spec: SeriesSpec, freq: str = "D", cfg: ArimaConfig = ArimaConfig(), regressors: Sequence[str] = ()) -> DataFrame:
    """One row per series with all that a forecast needs: orders, coefficients, and the few last values. It may be stored.

    ``auto`` takes the seasonal difference order from the stability of the seasonal pattern, the difference order from
    the KPSS test and the other orders by AIC. ``regressors`` are columns of ``df``; scaling one changes no forecast.
    Rows without a value of the target or of a regressor are left out.
    """
    regressors = list(regressors)
    m = cfg.m(freq)
    seasonal = cfg.seasonal and m > 1 and (cfg.max_sd if cfg.auto else cfg.sd) > 0
    cands = _candidates(cfg)
    max_p, max_q = max(c[0] for c in cands), max(c[1] for c in cands)
    max_sp, max_sq = max(c[2] for c in cands), max(c[3] for c in cands)
    ar_lags = list(range(1, max_p + 1)) + [m * i for i in range(1, max_sp + 1)]
    ma_lags = list(range(1, max_q + 1)) + [m * i for i in range(1, max_sq + 1)]
    long_ar = max(10, max_p + m * max(max_sp, max_sq, 1))
    deepest = max([1, *ar_lags, *ma_lags])

    y = F.col(spec.y).cast("double")
    levels = [f"_l{k}" for k in range(len(regressors))]
    base = present(df, spec).select(*spec.by, spec.ts, *spec.tie, y.alias(spec.y), *[number_or_null(c).cast("double").alias(n) for c, n in zip(regressors, levels)])
    base = base.dropna(subset=levels) if levels else base
    rows = order_series(base, spec).indexed()
    if cfg.auto:
        tested = rows
        if levels:  # orders are those of the errors
            plain = gram(rows.withColumn("_one", F.lit(1.0)), spec.by, ["_one", *levels, spec.y])
            plain = materialize(plain.select(*spec.by, F.coalesce(regress("gram", "n"), F.array(*[F.lit(0.0)] * (len(levels) + 1))).alias("_b")))
            tested = attach(rows, plain, spec.by).withColumn(spec.y, _less(spec.y, levels, "_b")).drop("_b", *levels)
        rows = attach(rows, difference_orders(tested, spec, cfg, m), spec.by)
    else:
        rows = rows.withColumns({"d": F.lit(cfg.d), "sd": F.lit(cfg.sd if seasonal else 0)})

    # 1. Differences.
    w = block_window(spec.by)
    steps = halo_blocks(rows, back=2 + m * seasonal)
    steps = steps.withColumns({"_w": _differenced(spec.y, w, m, seasonal), **{f"_x{k}": _differenced(c, w, m, seasonal) for k, c in enumerate(levels)}})
    steps = steps.filter(F.col(OWN)).drop(BLK, OWN).withColumn("_s", F.col("d") + m * F.col("sd"))
    if levels:
        steps = materialize(steps)
        beta = regression_coefficients(steps, spec, levels, m, cfg.seasonal and m > 1)
        names = [f"_x{k}" for k in range(len(levels))]
        steps = attach(steps, beta, spec.by)
        steps = steps.withColumns({spec.y: _less(spec.y, levels, "_beta"), "_w": _less("_w", names, "_beta")}).drop("_beta", *names, *levels)

    # 2. Innovations from a long autoregression.
    blocks = halo_blocks(steps, back=long_ar)
    names = [f"_w{k}" for k in range(1, long_ar + 1)]
    wide = blocks.select("*", *[F.lag("_w", k).over(w).alias(f"_w{k}") for k in range(1, long_ar + 1)]).filter(F.col(OWN)).drop(BLK, OWN)
    full = wide.filter(F.col(IDX) >= F.col("_s") + long_ar)
    first = gram(full.withColumn("_one", F.lit(1.0)), spec.by, ["_one", *names, "_w"])

    phi = first.select(*spec.by, regress("gram", "n").alias("_phi"))
    fitted = F.element_at("_phi", 1)
    for k in range(1, long_ar + 1):
        fitted = fitted + F.element_at("_phi", k + 1) * F.col(f"_w{k}")
    shocks = attach(wide, phi, spec.by).withColumn("_e", F.when(F.col(IDX) >= F.col("_s") + long_ar, F.col("_w") - fitted))
    shocks = materialize(shocks.select(*spec.by, spec.ts, spec.y, IDX, LEN, "d", "sd", "_s", "_w", "_e"))

    # 3. One matrix of sums for every candidate order.
    blocks = halo_blocks(shocks, back=deepest)
    arma = {f"_a{k}": F.lag("_w", k).over(w) for k in ar_lags}
    arma.update({f"_b{k}": F.lag("_e", k).over(w) for k in ma_lags})
    design = blocks.select("*", *[c.alias(n) for n, c in arma.items()]).filter(F.col(OWN) & (F.col(IDX) >= F.col("_s") + long_ar + deepest))
    second = gram(design.withColumn("_one", F.lit(1.0)), spec.by, ["_one", *arma, "_w"])
    where = {n: i + 1 for i, n in enumerate(arma)}

    @F.pandas_udf("struct<p int, q int, sp int, sq int, beta array<double>, lags array<int>, kinds array<int>, sigma2 double, aic double>")
    def choose(flat: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for v, rows_n in zip(flat, n):
            g = square(v)
            target = g.shape[0] - 1
            best = None
            for p, q, a, b in cands:
                ar = list(dict.fromkeys([*range(1, p + 1), *[m * i for i in range(1, a + 1)]]))
                ma = list(dict.fromkeys([*range(1, q + 1), *[m * i for i in range(1, b + 1)]]))
                cols = [0, *[where[f"_a{k}"] for k in ar], *[where[f"_b{k}"] for k in ma]]
                if rows_n <= len(cols) + 2:
                    continue
                beta, rss, _ = least_squares(g, cols, target)
                s2 = max(rss / rows_n, 1e-300)
                aic = rows_n * (np.log(s2) + 1 + np.log(2 * np.pi)) + 2 * (len(cols) + 1)
                if best is None or aic < best[-1]:
                    best = (p, q, a, b, beta.tolist(), [*ar, *ma], [0] * len(ar) + [1] * len(ma), float(s2), float(aic))
            out.append(best or (None,) * 9)
        return pd.DataFrame(out, columns=["p", "q", "sp", "sq", "beta", "lags", "kinds", "sigma2", "aic"])

    chosen = second.select(*spec.by, choose("gram", "n").alias("_f"))

    # 4. The last values of each series, from which a forecast goes on.
    tail_rows = max(deepest, 4 + m * seasonal)
    tail = shocks.filter(F.col(IDX) >= F.col(LEN) - tail_rows).groupBy(*spec.by).agg(
        F.sort_array(F.collect_list(F.struct(IDX, F.col(spec.y).alias("y"), F.col("_w").alias("w"), F.col("_e").alias("e")))).alias("_t"),
        F.max("d").alias("d"), F.max("sd").alias("sd"), F.max(spec.ts).alias("_last"),
    ).filter(F.col("_last").isNotNull())
    state = series_join(tail, chosen, spec.by)
    return materialize(series_join(state, beta, spec.by) if levels else state.withColumn("_beta", F.array(F.lit(0.0))))


def predict_arima(state: DataFrame, spec: SeriesSpec, horizon: int = 30, freq: str = "D", cfg: ArimaConfig = ArimaConfig(),
                  regressors: Sequence[str] = (), future: DataFrame | None = None) -> DataFrame:
    """Forecast rows (h, ts, yhat, lo, hi, level) with the chosen orders as ``model_order``, from a fitted state.

    With regressors ``future`` has their values for the forecast times of each series, and ``coefficients`` comes back; where
    a future value is missing the forecast is NULL. Series too short for the regressions keep their last value, without a band.
    """
    regressors = list(regressors)
    levels = [f"_l{k}" for k in range(len(regressors))]
    m = cfg.m(freq)
    z = NormalDist().inv_cdf(0.5 + cfg.level / 2)

    @F.pandas_udf("array<struct<h int, yhat double, lo double, hi double>>")
    def project(ys: pd.Series, ws: pd.Series, es: pd.Series, ds: pd.Series, sds: pd.Series, fit: pd.DataFrame) -> pd.Series:
        out = []
        for i in range(len(ys)):
            beta = fit["beta"].iloc[i]
            out.append(_project(ys.iloc[i], ws.iloc[i], es.iloc[i], int(ds.iloc[i]), int(sds.iloc[i]), m, beta, fit["lags"].iloc[i],
                                fit["kinds"].iloc[i], fit["sigma2"].iloc[i], horizon, z))
        return pd.Series(out)

    column = {c: field_of("_t", c) for c in ("y", "w", "e")}
    paths = state.select(*spec.by, "_beta", "_last", "d", "sd", "_f", F.explode(project(column["y"], column["w"], column["e"], F.col("d"), F.col("sd"), F.col("_f"))).alias("_p"))
    order = F.when(F.col("_f.p").isNotNull(), F.format_string("(%d,%d,%d)(%d,%d,%d,%d)", F.col("_f.p"), F.col("d"), F.col("_f.q"),
                                                              F.col("_f.sp"), F.col("sd"), F.col("_f.sq"), F.lit(m)))
    out = paths.select(*spec.by, "_beta", "_p.h", add_steps(F.col("_last"), F.col("_p.h"), freq).alias(spec.ts), "_p.yhat", "_p.lo", "_p.hi",
                       F.lit(cfg.level).alias("level"), order.alias("model_order"))
    if not levels:
        return out.drop("_beta")
    ahead = future.select(*spec.by, spec.ts, *[number_or_null(c).cast("double").alias(n) for c, n in zip(regressors, levels)])
    effect = sum((F.element_at("_beta", k + 2) * F.col(n) for k, n in enumerate(levels)), F.lit(0.0))
    out = side_join(out, ahead, [*spec.by, spec.ts])
    return out.withColumns({c: F.col(c) + effect for c in ("yhat", "lo", "hi")}).withColumn("coefficients", F.slice("_beta", 2, len(levels))).drop("_beta", *levels)


def _project(y, w, e, d, sd, m, beta, lags, kinds, sigma2, horizon, z) -> list[tuple]:
    """Point path, and a band from the weights of the infinite moving average."""
    y = [float(v) for v in y]
    if beta is None:
        return [(h, y[-1], None, None) for h in range(1, horizon + 1)]
    w = [0.0 if v is None or np.isnan(v) else float(v) for v in np.asarray(w, dtype=float)]
    e = [0.0 if v is None or np.isnan(v) else float(v) for v in np.asarray(e, dtype=float)]
    # (1-B)^d (1-B^m)^sd as coefficients of past values.
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(sd):
        poly = np.convolve(poly, [1.0, *[0.0] * (m - 1), -1.0])
    ar = np.zeros(max([0, *[k for k, t in zip(lags, kinds) if t == 0]]) + 1)
    ma = np.zeros(horizon + 1 + max([0, *lags]))
    ar[0], ma[0] = 1.0, 1.0
    for b, k, t in zip(beta[1:], lags, kinds):
        if t == 0:
            ar[k] -= b
        else:
            ma[k] += b
    full = np.convolve(ar, poly)
    psi = np.zeros(horizon)
    for j in range(horizon):
        past = sum(full[k] * psi[j - k] for k in range(1, min(j, len(full) - 1) + 1))
        psi[j] = ma[j] - past
    spread = z * np.sqrt(sigma2 * np.cumsum(psi**2))
    out = []
    for h in range(horizon):
        nxt = beta[0]
        for b, k, t in zip(beta[1:], lags, kinds):
            source = w if t == 0 else e
            nxt += b * (source[-k] if k <= len(source) else 0.0)
        w.append(nxt)
        e.append(0.0)
        level = nxt - sum(poly[k] * y[-k] for k in range(1, len(poly)) if k <= len(y))
        y.append(level)
        out.append((h + 1, float(level), float(level - spread[h]), float(level + spread[h])))
    return out
