"""Lag, rolling, calendar and difference features."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesloom.operators.index import BLK, IDX, LEN, OWN, halo_blocks, indexed_rows, windowed
from seriesloom.operators.joins import attach, keyed_join, number_or_null
from seriesloom.operators.series import modal_step
from seriesloom.spec import SeriesSpec


def lag_features(df: DataFrame, spec: SeriesSpec, lags: Sequence[int] = (1, 7, 14)) -> DataFrame:
    return windowed(df, spec, lambda w: {f"{spec.y}_lag_{k}": F.lag(spec.y, k).over(w) for k in lags}, back=max(lags))


def _rolling(y: str, w, size: int, shift: int) -> tuple[Column, Column]:
    """Mean and sample deviation over ``size`` rows, NULL until all of them are present."""
    frame = w.rowsBetween(-(size - 1) - shift, -shift)
    v = number_or_null(y)
    full = F.count(v).over(frame) == size
    return F.when(full, F.avg(v).over(frame)), F.when(full, F.stddev_samp(v).over(frame))


def rolling_features(df: DataFrame, spec: SeriesSpec, windows: Sequence[int] = (7, 14, 30)) -> DataFrame:
    def make(w):
        out = {}
        for n in windows:
            out[f"{spec.y}_rolling_mean_{n}"], out[f"{spec.y}_rolling_std_{n}"] = _rolling(spec.y, w, n, 0)
        return out

    return windowed(df, spec, make, back=max(windows) - 1)


def tree_lag_features(df: DataFrame, spec: SeriesSpec, lags: Sequence[int] = (1, 7, 14, 28)) -> DataFrame:
    return windowed(df, spec, lambda w: {f"lag_{k}": F.lag(spec.y, k).over(w) for k in lags}, back=max(lags))


def tree_rolling_features(df: DataFrame, spec: SeriesSpec, windows: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """Rolling statistics that end one row before the current one."""
    def make(w):
        out = {}
        for n in windows:
            out[f"rolling_mean_{n}"], out[f"rolling_std_{n}"] = _rolling(spec.y, w, n, 1)
        return out

    return windowed(df, spec, make, back=max(windows))


def ewm_reach(span: float) -> int:
    """Rows after which an exponential weight is below double precision."""
    return max(1, math.ceil(math.log(1e-16) / math.log(1 - 2 / (span + 1))))


def _ewm_columns(spec: SeriesSpec, span: float, reach: int) -> tuple[Column, Column]:
    """Weighted sums over the rows before the current one in its block.

    Weights are taken relative to the start of the block, so both sums are plain
    running sums; a block and its padding are ``reach`` rows each, which keeps the
    weights within 1e-32..1.
    """
    r = 1 - 2 / (span + 1)
    place = F.col(IDX) - (F.col(BLK) + 1) * F.lit(reach)
    weight = F.pow(F.lit(r), -place.cast("double"))
    w = W.partitionBy(*spec.by, BLK).orderBy(IDX).rowsBetween(W.unboundedPreceding, -1)
    y = number_or_null(spec.y)
    return F.sum(y * weight).over(w), F.sum(F.when(y.isNotNull(), weight)).over(w)


def _made_here(df: DataFrame) -> list[str]:
    """Index columns to drop again, unless the input brought them."""
    return [] if IDX in df.columns else [IDX, LEN]


def ewm_feature(df: DataFrame, spec: SeriesSpec, span: int = 7, out: str | None = None) -> DataFrame:
    """Exponentially weighted mean of the previous rows, with adjusted weights."""
    reach = ewm_reach(span)
    rows = indexed_rows(df, spec)
    blocks = halo_blocks(rows, back=reach, block=reach)
    num, den = _ewm_columns(spec, span, reach)
    return (
        blocks.select("*", (num / den).alias(out or f"ewm_{span}"))
        .filter(F.col(OWN)).drop(BLK, OWN, *_made_here(df))
    )


def date_features(df: DataFrame, ts: str,
                  parts: Sequence[str] = ("day_of_week", "month", "quarter", "year", "is_weekend")) -> DataFrame:
    made = {
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year": F.year(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    }
    return df.withColumns({p: made[p] for p in parts})


def tree_date_features(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"month": F.month(ts), "day_of_week": F.weekday(ts), "day_of_year": F.dayofyear(ts)})


def cyclic_columns(ts: str) -> dict[str, Column]:
    dow = F.lit(2 * math.pi) * F.weekday(ts) / 7
    mon = F.lit(2 * math.pi) * (F.month(ts) - 1) / 12
    return {"feat_dofw_sin": F.sin(dow), "feat_dofw_cos": F.cos(dow), "feat_month_sin": F.sin(mon), "feat_month_cos": F.cos(mon)}


def cyclic_features(df: DataFrame, ts: str) -> DataFrame:
    """Sine and cosine of weekday and month; existing columns are kept as they are."""
    return df.withColumns({n: c for n, c in cyclic_columns(ts).items() if n not in df.columns})


def fourier_columns(ts: str, harmonics: int = 3) -> dict[str, Column]:
    out = {}
    for k in range(1, harmonics + 1):
        angle = F.lit(2 * math.pi * k) * F.dayofyear(ts) / 365.25
        out[f"feat_sin_year_{k}"], out[f"feat_cos_year_{k}"] = F.sin(angle), F.cos(angle)
    return out


def fourier_year(df: DataFrame, spec: SeriesSpec, harmonics: int = 3) -> DataFrame:
    """Yearly harmonics for series whose modal step is at most a day, NULL for others."""
    gated = attach(df, modal_step(df, spec).withColumnRenamed("step_seconds", "_step"), spec.by)
    made = {n: F.when(F.col("_step") <= 86400, c) for n, c in fourier_columns(spec.ts, harmonics).items() if n not in df.columns}
    return gated.withColumns(made).drop("_step")


def future_temporal_features(grid: DataFrame, ts: str, harmonics: int = 3) -> DataFrame:
    """The calendar terms on a future grid."""
    return cyclic_features(grid, ts).withColumns(fourier_columns(ts, harmonics))


def holiday_flag(df: DataFrame, holidays: DataFrame, ts: str, out: str = "is_holiday") -> DataFrame:
    """1 on dates listed in ``holidays`` (column ``ts``), else 0."""
    days = holidays.select(F.to_date("ts").alias("_day"), F.lit(1).alias("_hit")).distinct()
    joined = keyed_join(df.withColumn("_day", F.to_date(ts)), days, ["_day"])
    return joined.withColumn(out, F.coalesce(F.col("_hit"), F.lit(0))).drop("_hit", "_day")


def diff_regular(df: DataFrame, spec: SeriesSpec, order: int = 1, iterated: bool = False) -> DataFrame:
    """``order`` columns of first differences; with ``iterated`` the n-th is the n-th difference."""
    def make(w):
        out = {}
        for n in range(1, order + 1):
            top = n if iterated else 1
            terms = [F.lit(float((-1) ** k * math.comb(top, k))) * F.lag(spec.y, k).over(w) for k in range(1, top + 1)]
            out[f"{spec.y}_diff_{n}"] = sum(terms, F.col(spec.y))
        return out

    return windowed(df, spec, make, back=order if iterated else 1)


def diff_seasonal(df: DataFrame, spec: SeriesSpec, period: int = 7) -> DataFrame:
    return windowed(df, spec, lambda w: {f"{spec.y}_seasonal_diff": F.col(spec.y) - F.lag(spec.y, period).over(w)}, back=period)


def target_delta(df: DataFrame, spec: SeriesSpec, out: str = "label") -> DataFrame:
    """Target minus ``lag_1``, or the target itself where that column is absent."""
    y = F.col(spec.y)
    return df.withColumn(out, y - F.col("lag_1") if "lag_1" in df.columns else y)


def tree_features(df: DataFrame, spec: SeriesSpec, lags: Sequence[int] = (1, 7, 14, 28),
                  windows: Sequence[int] = (7, 14, 30), span: int | None = 7) -> DataFrame:
    """All tree features in one pass over the ordered rows, before any split."""
    reach = ewm_reach(span) if span else 1
    rows = indexed_rows(df, spec)
    size = max(reach, *lags, *windows)
    blocks = halo_blocks(rows, back=size, block=size if span else None)
    w = W.partitionBy(*spec.by, BLK).orderBy(IDX)
    exprs = {f"lag_{k}": F.lag(spec.y, k).over(w) for k in lags}
    for n in windows:
        exprs[f"rolling_mean_{n}"], exprs[f"rolling_std_{n}"] = _rolling(spec.y, w, n, 1)
    if span:
        num, den = _ewm_columns(spec, span, size)
        exprs[f"ewm_{span}"] = num / den
    out = blocks.select("*", *[e.alias(n) for n, e in exprs.items()]).filter(F.col(OWN)).drop(BLK, OWN, *_made_here(df))
    return tree_date_features(out, spec.ts)
