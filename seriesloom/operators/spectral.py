"""Autocorrelation, decomposition and seasonality."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.operators.index import IDX, LEN, BLK, OWN, block_window, halo_blocks, order_series
from seriesloom.operators.joins import attach, keyed_join, series_join
from seriesloom.operators.profile import present
from seriesloom.operators.series import frequency_code, modal_step
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec

#: Seasonal period by frequency code, and the period of an unknown frequency (fixed values).
PERIODS = {"D": 7, "W": 52, "M": 12, "Q": 4, "Y": 1, "H": 24, "30T": 48, "15T": 96}
DEFAULT_PERIOD = 24


def centred_rows(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Present rows in order, with the target less its mean as ``_c``."""
    rows = present(df, spec)
    y = F.col(spec.y).cast("double")
    mean = rows.groupBy(*spec.by).agg(F.avg(y).alias("_mu"))
    centred = attach(rows, mean, spec.by).select(*spec.by, spec.ts, *spec.tie, (y - F.col("_mu")).alias("_c"))
    return order_series(centred, SeriesSpec(ts=spec.ts, y="_c", group=spec.group, tie=spec.tie)).indexed()


def lag_products(indexed: DataFrame, spec: SeriesSpec, lags: int) -> DataFrame:
    """From ordered rows with a centred column ``_c``: n, and sums of c[t]c[t-k] for k = 0..lags as an array.

    All products of a row are formed from its padded block, so nothing is joined or multiplied out.
    """
    blocks = halo_blocks(indexed, back=lags)
    w = block_window(spec.by)
    lagged = blocks.select(*spec.by, OWN, "_c", *[F.lag("_c", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    own = lagged.filter(F.col(OWN))
    sums = [F.sum(F.col("_c") * F.col("_c"))] + [F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, lags + 1)]
    return own.groupBy(*spec.by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("products"))


def _acf_array(df: DataFrame, spec: SeriesSpec, lags: int) -> DataFrame:
    p = lag_products(centred_rows(df, spec), spec, lags)
    zero = F.element_at("products", 1)
    values = F.transform("products", lambda v: v / F.nullif(zero, F.lit(0.0)))
    return p.select(*spec.by, "n", values.alias("acf"))


def acf(df: DataFrame, spec: SeriesSpec, max_lags: int = 40) -> DataFrame:
    """Biased autocorrelation for lags 0..min(max_lags, n // 2), one row per lag."""
    a = _acf_array(df, spec, max_lags)
    return a.select(*spec.by, "n", F.posexplode("acf").alias("lag", "acf")).filter(
        F.col("lag") <= F.least(F.lit(max_lags), F.floor(F.col("n") / 2))
    ).drop("n")


def _partial_from_acf(r: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion on autocorrelations r[0..K]."""
    k_max = len(r) - 1
    out = np.ones(k_max + 1)
    phi = np.zeros(k_max + 1)
    err = r[0]
    for k in range(1, k_max + 1):
        coef = (r[k] - phi[1:k] @ r[k - 1:0:-1]) / err if err > 0 else np.nan
        old = phi[1:k].copy()
        phi[1:k] = old - coef * old[::-1]
        phi[k] = coef
        err *= 1 - coef * coef
        out[k] = coef
    return out


def pacf(df: DataFrame, spec: SeriesSpec, max_lags: int = 40, adjusted: bool = False) -> DataFrame:
    """Yule-Walker partial autocorrelation; ``adjusted`` divides each lag by n - k instead of n."""
    a = _acf_array(df, spec, max_lags)

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for size, v in zip(n, values):
            r = np.asarray(v[: min(max_lags, int(size) // 2) + 1], dtype=float)
            if adjusted:
                r = r * size / (size - np.arange(len(r)))
            out.append(_partial_from_acf(r) if len(r) and np.isfinite(r).all() else [None] * len(r))
        return pd.Series(out)

    return a.select(*spec.by, solve("n", "acf").alias("_p")).select(*spec.by, F.posexplode("_p").alias("lag", "pacf"))


def _period_of(freq: Column) -> Column:
    pairs = [x for k, v in PERIODS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[freq], F.lit(DEFAULT_PERIOD))


def series_frequency(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    step = modal_step(df, spec)
    ends = df.groupBy(*spec.by).agg(F.count(F.lit(1)).alias("_rows"))
    freq = frequency_code(F.col("step_seconds"))
    return series_join(ends, step, spec.by).select(*spec.by, freq.alias("frequency")).withColumn("period", _period_of(F.col("frequency")))


def _top(df: DataFrame, column: str) -> int:
    """Largest value of a one-row-per-series column: a single number for the driver."""
    return int(df.agg(F.coalesce(F.max(column), F.lit(0))).first()[0])


def seasonality_acf(df: DataFrame, spec: SeriesSpec, freqs: DataFrame | None = None) -> DataFrame:
    """Highest autocorrelation within two lags of the expected period, against a threshold."""
    freqs = freqs if freqs is not None else series_frequency(df, spec)
    widest = min(100, _top(freqs, "period") + 2)
    a = series_join(_acf_array(df, spec, widest), freqs, spec.by)
    limit = F.least(F.floor(F.col("n") / 2), F.col("period") * 3, F.lit(100))
    lag = F.explode(F.sequence(F.greatest(F.lit(1), F.col("period") - 2), F.col("period") + 2))
    near = a.select(*spec.by, "frequency", "period", "n", "acf", limit.alias("_limit"), lag.alias("lag"))
    near = near.filter((F.col("lag") <= F.col("_limit")) & (F.col("lag") <= F.lit(widest)))
    near = near.withColumn("_r", F.try_element_at("acf", F.col("lag").cast("int") + 1))
    best = near.groupBy(*spec.by).agg(F.max(F.struct(F.col("_r"), (-F.col("lag")).alias("neg"))).alias("_b"))
    if not spec.by:
        best = best.filter(F.col("_b").isNotNull())
    out = series_join(freqs, best, spec.by)
    threshold = F.when(F.col("frequency") == "D", 0.25).otherwise(0.15)
    hit = F.coalesce(F.col("_b._r") > threshold, F.lit(False))
    return out.select(*spec.by, "frequency", "period", hit.alias("acf_detected"),
                      F.when(hit, -F.col("_b.neg")).cast("int").alias("acf_period"),
                      F.when(hit, F.col("_b._r")).otherwise(0.0).alias("acf_confidence"))


def seasonal_decompose(df: DataFrame, spec: SeriesSpec, period: int = 7, last: int | None = None) -> DataFrame:
    """Additive decomposition into trend, seasonal and resid columns.

    The trend is a centred moving average over one period, continued at both ends by a
    line through the nearest ``period`` values. Series shorter than two periods are left
    out. ``last`` restricts each series to its final rows.
    """
    base = order_series(present(df, spec), spec)
    rows = base.indexed()
    if last:
        cut = F.greatest(F.col(LEN) - last, F.lit(0))
        rows = rows.filter(F.col(IDX) >= cut).withColumn(IDX, F.col(IDX) - cut).withColumn(LEN, F.least(F.col(LEN), F.lit(last)))
    rows = rows.filter(F.col(LEN) >= 2 * period)
    half = period // 2
    blocks = halo_blocks(rows, back=half, ahead=half) if half else rows.withColumn(BLK, F.lit(0)).withColumn(OWN, F.lit(True))
    w = block_window(spec.by)
    y = F.col(spec.y).cast("double")
    if not half:
        trend = y
    elif period % 2:
        trend = F.avg(y).over(w.rowsBetween(-half, half))
    else:
        inner = F.sum(y).over(w.rowsBetween(-half + 1, half - 1))
        trend = (inner + 0.5 * F.lag(y, half).over(w) + 0.5 * F.lead(y, half).over(w)) / period
    inside = (F.col(IDX) >= half) & (F.col(IDX) <= F.col(LEN) - 1 - half)
    out = blocks.select("*", trend.alias("_t")).filter(F.col(OWN)).drop(BLK, OWN).withColumn("_t", F.when(inside, F.col("_t")))
    front, back = F.lit(half), F.col(LEN) - 1 - half
    x = F.col(IDX).cast("double")
    near_front = (F.col(IDX) >= front) & (F.col(IDX) < F.least(front + period, back))
    near_back = (F.col(IDX) >= F.greatest(front, back - period)) & (F.col(IDX) < back)
    lines = out.filter(near_front | near_back).groupBy(*spec.by).agg(
        *[f(F.when(cond, F.col("_t")), F.when(cond, x)).alias(n)
          for cond, tag in ((near_front, "f"), (near_back, "b"))
          for f, n in ((F.regr_slope, f"_s{tag}"), (F.regr_intercept, f"_i{tag}"))]
    )
    out = attach(out, lines, spec.by)
    line = F.when(F.col(IDX) < front, F.col("_if") + F.col("_sf") * x).otherwise(F.col("_ib") + F.col("_sb") * x)
    out = out.withColumn("trend", F.coalesce(F.col("_t"), line)).drop("_t", "_sf", "_if", "_sb", "_ib")
    out = out.withColumn("_ph", (F.col(IDX) % period).cast("int"))
    means = out.groupBy(*spec.by, "_ph").agg(F.avg(y - F.col("trend")).alias("_m"))
    level = means.groupBy(*spec.by).agg(F.avg("_m").alias("_lv"))
    phases = series_join(means, level, spec.by).select(*spec.by, "_ph", (F.col("_m") - F.col("_lv")).alias("seasonal"))
    out = keyed_join(out, phases, [*spec.by, "_ph"])
    return out.withColumn("resid", y - F.col("trend") - F.col("seasonal")).drop("_ph", LEN).withColumnRenamed(IDX, "idx")


def seasonality_decomp(df: DataFrame, spec: SeriesSpec, freqs: DataFrame | None = None, periods: int = 10) -> DataFrame:
    """Share of the seasonal variance in the last ten periods; above 0.1 counts as seasonal.

    One decomposition per period that occurs among the series; there are at most nine.
    """
    freqs = freqs if freqs is not None else series_frequency(df, spec)
    found = sorted(r[0] for r in freqs.select("period").distinct().collect())
    strength = freqs.select(*spec.by, F.lit(None).cast("double").alias("_st")).limit(0)
    for p in found:
        only = freqs.filter(F.col("period") == p)
        part = attach(df, only.select(*spec.by, F.lit(1).alias("_k")), spec.by, "inner").drop("_k") if spec.by else df
        dec = seasonal_decompose(part, spec, p, last=p * periods)
        s = dec.groupBy(*spec.by).agg(F.var_pop("seasonal").alias("_vs"), F.var_pop("resid").alias("_vr"))
        s = s.select(*spec.by, (F.col("_vs") / F.nullif(F.col("_vs") + F.col("_vr"), F.lit(0.0))).alias("_st"))
        strength = strength.unionByName(s)
    out = series_join(freqs, strength, spec.by)
    hit = F.coalesce(F.col("_st") > 0.1, F.lit(False))
    return out.select(*spec.by, "frequency", "period", hit.alias("decomp_detected"),
                      F.when(hit, F.col("period")).alias("decomp_period"),
                      F.when(hit, F.col("_st")).otherwise(0.0).alias("decomp_strength"))


def seasonality_hybrid(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Either method may detect; when both do, the larger value decides the period."""
    freqs = materialize(series_frequency(df, spec))
    size = present(df, spec).groupBy(*spec.by).agg(F.count(F.lit(1)).alias("n"))
    a = seasonality_acf(df, spec, freqs)
    d = seasonality_decomp(df, spec, freqs).drop("frequency", "period")
    both = series_join(series_join(a, d, spec.by), size, spec.by)
    known = F.col("frequency").isin(list(PERIODS))
    usable = known | (F.col("n") >= 24)
    ha, hd = F.col("acf_detected") & usable, F.col("decomp_detected") & usable
    acf_wins = F.col("acf_confidence") > F.col("decomp_strength")
    period = (
        F.when(ha & hd, F.when(acf_wins, F.col("acf_period")).otherwise(F.col("decomp_period")))
        .when(ha, F.col("acf_period")).when(hd, F.col("decomp_period"))
    )
    strength = (
        F.when(ha & hd, F.greatest("acf_confidence", "decomp_strength")).when(ha, F.col("acf_confidence"))
        .when(hd, F.col("decomp_strength")).otherwise(0.0)
    )
    method = F.when(ha & hd, "acf_and_decomposition").when(ha, "acf").when(hd, "decomposition").otherwise("none")
    return both.select(*spec.by, (ha | hd).alias("detected"), period.cast("int").alias("seasonal_period"), strength.alias("strength"),
                       (strength * 100).alias("confidence"), method.alias("method"))
