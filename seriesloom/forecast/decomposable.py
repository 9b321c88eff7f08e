"""Trend plus seasonality plus regressors, fitted by ridge regression.

The design has a line with hinge changepoints over the first 80 % of the history,
Fourier terms, and standardised regressors. Its normal equations are summed by Spark
for all series at once; the small system of each series is solved on its reduced row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seriesloom.functions.linalg import gram, least_squares, square
from seriesloom.operators.joins import attach, series_join
from seriesloom.operators.profile import present
from seriesloom.operators.series import micros, modal_step
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec


@dataclass(frozen=True)
class DecomposableConfig:
    """Defaults are fixed values."""

    changepoints: int = 50
    changepoint_prior: float = 0.2
    seasonality_prior: float = 5.0
    multiplicative: bool = True
    interval: float = 0.8
    yearly: bool | None = None
    weekly: bool | None = None
    daily: bool = False
    regressors: Sequence[str] = field(default=())


def _design(pdf: pd.DataFrame, cfg: DecomposableConfig) -> np.ndarray:
    t = pdf["_t"].to_numpy(float)
    day = pdf["_day"].to_numpy(float)
    parts = [np.ones((len(t), 1)), t[:, None]]
    if cfg.changepoints:
        knots = np.arange(1, cfg.changepoints + 1) / (cfg.changepoints + 1) * 0.8
        parts.append(np.maximum(t[:, None] - knots, 0.0))
    for on, length, order in (("_yr", 365.25, 10), ("_wk", 7.0, 3), ("_dy", 1.0, 4)):
        angle = 2 * np.pi * day[:, None] / length * np.arange(1, order + 1)
        parts.append(np.hstack([np.sin(angle), np.cos(angle)]) * pdf[on].to_numpy(float)[:, None])
    for c in cfg.regressors:
        parts.append(pdf[c].to_numpy(float)[:, None])
    return np.hstack(parts)


def _penalty(cfg: DecomposableConfig) -> np.ndarray:
    seasonal = 2 * (10 + 3 + 4)
    prior = [np.inf, np.inf, *[cfg.changepoint_prior] * cfg.changepoints, *[cfg.seasonality_prior] * seasonal, *[10.0] * len(cfg.regressors)]
    return 1.0 / np.square(np.asarray(prior))


def _place(rows: DataFrame, stats: DataFrame, spec: SeriesSpec, cfg: DecomposableConfig) -> DataFrame:
    """Design inputs: scaled time, day number, switches and standardised regressors."""
    out = attach(rows, stats, spec.by)
    us = micros(spec.ts)
    new = {"_t": (us - F.col("_a")) / F.col("_w"), "_day": us / F.lit(86400e6)}
    for c in cfg.regressors:
        new[c] = F.coalesce((F.col(c) - F.col(f"_mu_{c}")) / F.when(F.col(f"_sd_{c}") == 0, 1.0).otherwise(F.col(f"_sd_{c}")), F.lit(0.0))
    return out.withColumns(new)


def fit_decomposable(df: DataFrame, spec: SeriesSpec, cfg: DecomposableConfig = DecomposableConfig()) -> DataFrame:
    """One row per series: coefficients, residual deviation, and what prediction needs to know."""
    rows = present(df, spec)
    us, y = micros(spec.ts), F.col(spec.y).cast("double")
    stats = rows.groupBy(*spec.by).agg(
        F.count(F.lit(1)).alias("_n"), F.min(us).alias("_a"), F.max(us).alias("_b"), F.min(y).alias("_lo"),
        F.greatest(F.max(F.abs(y)), F.lit(1e-12)).alias("_scale"),
        *[F.avg(c).alias(f"_mu_{c}") for c in cfg.regressors], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cfg.regressors],
    )
    stats = series_join(stats, modal_step(rows, spec), spec.by)
    days = (F.col("_b") - F.col("_a")) / F.lit(86400e6)
    yearly = (days >= 365) if cfg.yearly is None else F.lit(cfg.yearly)
    weekly = ((days >= 14) & (F.col("step_seconds") < 7 * 86400)) if cfg.weekly is None else F.lit(cfg.weekly)
    stats = stats.withColumns({
        "_w": F.greatest(F.col("_b") - F.col("_a"), F.lit(1)).cast("double"), "_yr": F.coalesce(yearly, F.lit(False)).cast("double"),
        "_wk": F.coalesce(weekly, F.lit(False)).cast("double"), "_dy": F.lit(float(cfg.daily)),
        "_log": (F.col("_lo") > 0) & F.lit(cfg.multiplicative),
    }).drop("_b", "_lo", "step_seconds")
    stats = materialize(stats)
    placed = _place(rows, stats, spec, cfg).withColumn("_z", F.when(F.col("_log"), F.log(y)).otherwise(y / F.col("_scale")))
    inputs = ["_t", "_day", "_yr", "_wk", "_dy", *cfg.regressors, "_z"]
    sums = gram(placed, spec.by, inputs, lambda pdf: np.hstack([_design(pdf, cfg), pdf["_z"].to_numpy(float)[:, None]]))
    weights = _penalty(cfg)

    @F.pandas_udf("struct<beta array<double>, sigma double>")
    def solve(flat: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for v, m in zip(flat, n):
            g = square(v)
            k = g.shape[0] - 1
            _, rss, _ = least_squares(g, range(k), k, np.full(k, 1e-8))
            noise = max(rss / max(m - 2, 1), 1e-12)
            beta, rss, _ = least_squares(g, range(k), k, noise * weights + 1e-10)
            out.append((beta.tolist(), float(np.sqrt(rss / max(m - 2, 1)))))
        return pd.DataFrame(out, columns=["beta", "sigma"])

    fits = sums.select(*spec.by, solve("gram", "n").alias("_f")).select(*spec.by, "_f.beta", "_f.sigma")
    return materialize(series_join(stats, fits, spec.by))


def predict_decomposable(fits: DataFrame, grid: DataFrame, spec: SeriesSpec, cfg: DecomposableConfig = DecomposableConfig()) -> DataFrame:
    """Forecast, band at level ``cfg.interval`` and trend on the rows of ``grid``."""
    placed = _place(grid, fits, spec, cfg)
    keep = list(grid.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema.fields) + ", _m double, _tr double, sigma double, _log boolean, _scale double"
    n_trend = 2 + cfg.changepoints

    def apply(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _design(pdf, cfg)
            beta = np.vstack(pdf["beta"].to_numpy())
            out = pdf[keep].copy()
            out["_m"] = (x * beta).sum(axis=1)
            out["_tr"] = (x[:, :n_trend] * beta[:, :n_trend]).sum(axis=1)
            for c in ("sigma", "_log", "_scale"):
                out[c] = pdf[c].to_numpy()
            yield out

    needed = [*keep, *[c for c in ("_t", "_day", "_yr", "_wk", "_dy", "beta", "sigma", "_log", "_scale") if c not in keep]]
    out = placed.filter(F.col("beta").isNotNull()).select(*needed).mapInPandas(apply, schema)
    z = NormalDist().inv_cdf(0.5 + cfg.interval / 2)

    def level(c):
        return F.when(F.col("_log"), F.exp(c)).otherwise(c * F.col("_scale"))

    half = F.lit(z) * F.col("sigma")
    return out.select(
        *keep, level(F.col("_m")).alias("yhat"), level(F.col("_m") - half).alias("lo"), level(F.col("_m") + half).alias("hi"),
        F.lit(cfg.interval).alias("level"), level(F.col("_tr")).alias("trend"),
    )


def fc_decomposable(df: DataFrame, spec: SeriesSpec, grid: DataFrame, cfg: DecomposableConfig = DecomposableConfig()) -> DataFrame:
    """Fit on ``df`` and predict ``grid``, which carries the regressors if there are any."""
    return predict_decomposable(fit_decomposable(df, spec, cfg), grid, spec, cfg)
