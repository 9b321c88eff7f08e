"""Naive forecasts, their state, and intervals around them."""

from __future__ import annotations

from statistics import NormalDist
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesloom.operators.clean import add_steps
from seriesloom.operators.index import IDX, LEN, order_series, series_order
from seriesloom.operators.joins import keyed_join, series_join, side_join
from seriesloom.operators.profile import present
from seriesloom.spec import SeriesSpec

#: Up to this many rows per series are picked by row number, which Spark limits before the shuffle; more are picked by position.
_GROUP_LIMIT = 1000
#: Fixed value: half width of the simple 95 % band in deviations.
Z95 = 1.96


def future_dates(df: DataFrame, spec: SeriesSpec, horizon: int = 30, freq: str = "D") -> DataFrame:
    """The next ``horizon`` steps after the last timestamp of each series, with their number ``h``."""
    last = df.groupBy(*spec.by).agg(F.max(spec.ts).alias("_last")).filter(F.col("_last").isNotNull())
    steps = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))))
    return steps.select(*spec.by, "h", add_steps(F.col("_last"), F.col("h"), freq).alias(spec.ts))


def last_rows(df: DataFrame, spec: SeriesSpec, k: int) -> DataFrame:
    """The last ``k`` rows of each series with ``pos`` 0.. (oldest first) and their number ``m``.

    Rows of one timestamp are told apart by the tie columns, or else by the content of the row, for every ``k``.
    """
    order = [c.desc() for c in series_order(df, spec)]
    if k <= _GROUP_LIMIT:
        tail = df if spec.by else df.orderBy(*order).limit(k)
        top = tail.withColumn("_rn", F.row_number().over(W.partitionBy(*(spec.by or [F.lit(0)])).orderBy(*order))).filter(F.col("_rn") <= k)
    else:
        rows = order_series(df, spec).indexed()
        top = rows.filter(F.col(IDX) >= F.col(LEN) - k).withColumn("_rn", F.col(LEN) - F.col(IDX)).drop(IDX, LEN)
    m = F.count(F.lit(1)).over(W.partitionBy(*(spec.by or [F.lit(0)])))
    return top.withColumn("m", m).withColumn("pos", (F.col("m") - F.col("_rn")).cast("int")).drop("_rn")


def naive_state(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    order = F.struct(spec.ts, *spec.tie)
    return present(df, spec).groupBy(*spec.by).agg(F.max_by(spec.y, order).cast("double").alias("yhat"))


def seasonal_state(df: DataFrame, spec: SeriesSpec, period: int = 7) -> DataFrame:
    """The last ``period`` values of each series: columns ts, pos, m and the value."""
    keep = [*spec.by, spec.ts, *spec.tie, spec.y]
    return last_rows(present(df, spec).select(*keep), spec, period)


def fc_naive(df: DataFrame, spec: SeriesSpec, horizon: int = 30, freq: str = "D", grid: DataFrame | None = None) -> DataFrame:
    """The last value, repeated. ``grid`` replaces the default future dates (columns h, ts)."""
    grid = grid if grid is not None else future_dates(df, spec, horizon, freq)
    return series_join(grid, naive_state(df, spec), spec.by)


def tile_state(state: DataFrame, grid: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Repeat the kept values over the grid, cycling over as many as there are."""
    sizes = state.groupBy(*spec.by).agg(F.max("m").alias("_m"))
    placed = series_join(grid, sizes, spec.by).withColumn("pos", ((F.col("h") - 1) % F.col("_m")).cast("int")).drop("_m")
    values = state.select(*spec.by, "pos", F.col(spec.y).cast("double").alias("yhat"))
    return side_join(placed, values, [*spec.by, "pos"]).drop("pos")


def fc_seasonal_naive(df: DataFrame, spec: SeriesSpec, horizon: int = 30, freq: str = "D", period: int = 7,
                      grid: DataFrame | None = None) -> DataFrame:
    grid = grid if grid is not None else future_dates(df, spec, horizon, freq)
    return tile_state(seasonal_state(df, spec, period), grid, spec)


def fc_moving_average(df: DataFrame, spec: SeriesSpec, horizon: int = 30, freq: str = "D", window: int = 7,
                      grid: DataFrame | None = None) -> DataFrame:
    """Mean of the last ``window`` values, repeated."""
    grid = grid if grid is not None else future_dates(df, spec, horizon, freq)
    mean = last_rows(present(df, spec), spec, window).groupBy(*spec.by).agg(F.avg(spec.y).alias("yhat"))
    return series_join(grid, mean, spec.by)


def state_update(state: DataFrame, new: DataFrame, spec: SeriesSpec, period: int = 1) -> DataFrame:
    """New rows appended to the kept ones, of which the last ``period`` stay (1 for the naive model)."""
    keep = [*spec.by, spec.ts, *spec.tie, spec.y]
    merged = state.select(*keep).unionByName(present(new, spec).select(*keep))
    return last_rows(merged, spec, period)


def fc_intervals(forecast: DataFrame, history: DataFrame, spec: SeriesSpec, z: float = Z95) -> DataFrame:
    """A band of ``z`` sample deviations of the history around the forecast."""
    sd = present(history, spec).groupBy(*spec.by).agg(F.stddev_samp(spec.y).alias("_sd"))
    out = series_join(forecast, sd, spec.by)
    return out.withColumn("lo95", F.col("yhat") - z * F.col("_sd")).withColumn("hi95", F.col("yhat") + z * F.col("_sd")).drop("_sd")


def fc_intervals_multi(forecast: DataFrame, history: DataFrame, spec: SeriesSpec, levels: Sequence[float] = (0.95, 0.8)) -> DataFrame:
    """One row per forecast and level, with ``level``, ``lo`` and ``hi``."""
    sd = present(history, spec).groupBy(*spec.by).agg(F.stddev_samp(spec.y).alias("_sd"))
    table = F.array(*[F.struct(F.lit(float(p)).alias("level"), F.lit(NormalDist().inv_cdf(0.5 + p / 2)).alias("z")) for p in levels])
    out = series_join(forecast, sd, spec.by).withColumn("_z", F.explode(table))
    half = F.col("_z.z") * F.col("_sd")
    return out.select("*", F.col("_z.level").alias("level"), (F.col("yhat") - half).alias("lo"), (F.col("yhat") + half).alias("hi")).drop("_z", "_sd")


def fc_model_select(forecasts: DataFrame, mode: str = "best", ranked: DataFrame | None = None, by: Sequence[str] = (),
                    ts: str = "ts") -> DataFrame:
    """``best`` (needs a ranking), ``all``, ``ensemble`` (mean by date), or the name of one model."""
    if mode == "all":
        return forecasts
    if mode == "ensemble":
        return forecasts.groupBy(*by, ts).agg(F.avg("yhat").alias("yhat")).withColumn("model", F.lit("ensemble"))
    if mode == "best":
        if ranked is None:
            raise ValueError("mode 'best' needs a ranking")
        keys = [c for c in by if c in ranked.columns]
        winners = ranked.filter(F.col("rank") == 1).select(*keys, "model")
        return keyed_join(forecasts, winners, [*keys, "model"], "inner")
    return forecasts.filter(F.col("model") == mode)
