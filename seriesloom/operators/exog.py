"""Values of regressors on a future grid."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from seriesloom.operators.clean import fill_backward, fill_forward
from seriesloom.operators.joins import attach, keyed_join, series_join, side_join
from seriesloom.spec import SeriesSpec


def regressor_lookup(grid: DataFrame, regressors: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> DataFrame:
    """Regressor values by date; gaps are filled forward, backward, by the mean, by 0."""
    columns = list(columns)
    keys = [*spec.by, spec.ts]
    means = regressors.groupBy(*spec.by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    on_grid = side_join(grid, regressors.select(*keys, *columns), keys).select(*grid.columns, *columns)
    plain = SeriesSpec(ts=spec.ts, y=spec.y, group=spec.group)
    filled = fill_backward(fill_forward(on_grid, plain, columns), plain, columns)
    out = attach(filled, means, spec.by)
    return out.select(*grid.columns, *[F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)).alias(c) for c in columns])


def carry_exog(history: DataFrame, grid: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> DataFrame:
    """Past values for future dates: the row nearest to one year (365 days) before if within
    seven days, else the latest row of the same weekday, else the last row.

    The nearness join is an equi-join on the day: a future date asks for 15 days.
    """
    columns = list(columns)
    back = F.timestamp_add("DAY", F.lit(-365), F.col(spec.ts))
    asks = grid.select(*spec.by, F.col(spec.ts).alias("_t"), back.alias("_want"))
    asks = asks.withColumn("_day", F.explode(F.transform(F.sequence(F.lit(-7), F.lit(7)), lambda k: F.date_add(F.to_date("_want"), k))))
    values = F.struct(*columns).alias("_x")
    past = history.select(*spec.by, spec.ts, values, F.to_date(spec.ts).alias("_day"))
    met = keyed_join(past, asks, [*spec.by, "_day"], "inner")
    off = F.abs(F.timestamp_diff("MICROSECOND", F.col("_want"), F.col(spec.ts)))
    near = met.withColumn("_off", off).filter(F.col("_off") <= 7 * 86400 * 1_000_000)
    nearest = near.groupBy(*spec.by, "_t").agg(F.min(F.struct("_off", spec.ts, "_x")).alias("_b")).select(
        *spec.by, F.col("_t").alias(spec.ts), F.col("_b._x").alias("_x1")
    )
    weekday = history.groupBy(*spec.by, F.weekday(spec.ts).alias("_dow")).agg(F.max(F.struct(spec.ts, values)).alias("_b"))
    weekday = weekday.select(*spec.by, "_dow", F.col("_b._x").alias("_x2"))
    last = history.groupBy(*spec.by).agg(F.max(F.struct(spec.ts, values)).alias("_b")).select(*spec.by, F.col("_b._x").alias("_x3"))
    out = side_join(grid, nearest, [*spec.by, spec.ts])
    out = side_join(out.withColumn("_dow", F.weekday(spec.ts)), weekday, [*spec.by, "_dow"])
    if spec.by:
        out = series_join(out, last, spec.by)
        pick = F.coalesce("_x1", "_x2", "_x3")
    else:
        row = last.first()
        fallback = F.struct(*[F.lit(row[0][c] if row and row[0] else None).cast(history.schema[c].dataType).alias(c) for c in columns])
        pick = F.coalesce(F.col("_x1"), F.col("_x2"), fallback)
    return out.select(*grid.columns, *[pick[c].alias(c) for c in columns])


def last_value_exog(history: DataFrame, grid: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> DataFrame:
    """The last known value on every future date; 0 for columns the history lacks."""
    known = [c for c in columns if c in history.columns]
    out = grid
    if known:
        order = F.struct(spec.ts, *spec.tie)
        last = history.groupBy(*spec.by).agg(*[F.max_by(c, order).alias(c) for c in known])
        out = series_join(grid, last, spec.by)
    return out.select(*grid.columns, *[F.col(c) if c in known else F.lit(0.0).alias(c) for c in columns])
