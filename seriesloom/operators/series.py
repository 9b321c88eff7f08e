"""Building a regular series from raw rows, and basic ordered access to it."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesloom.operators.index import indexed_rows, series_order, windowed
from seriesloom.spec import SeriesSpec

NTZ = "timestamp_ntz"
#: Units that date_trunc and interval arithmetic know, by frequency code.
UNITS = {"H": "HOUR", "D": "DAY", "W": "WEEK", "M": "MONTH", "Q": "QUARTER", "Y": "YEAR"}


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01, without regard to the session time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(NTZ), c.cast(NTZ))


def build_series(df: DataFrame, ts: str, value: str, freq: str = "D", group: Sequence[str] = (),
                 how: str = "sum", out_ts: str = "ts", out_y: str = "y") -> DataFrame:
    """One row per (series, step): the aggregate of the raw rows falling into the step."""
    aggs = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
    step = F.date_trunc(UNITS[freq], F.col(ts)).cast(NTZ)
    return (
        df.select(*group, step.alias(out_ts), F.col(value).alias("_v"))
        .groupBy(*group, out_ts)
        .agg(aggs[how]("_v").cast("double").alias(out_y))
    )


def date_scope(df: DataFrame, spec: SeriesSpec, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both inclusive."""
    if start is not None:
        df = df.filter(F.col(spec.ts) >= F.lit(start).cast(NTZ))
    if end is not None:
        df = df.filter(F.col(spec.ts) <= F.lit(end).cast(NTZ))
    return df


def select_groups(df: DataFrame, column: str, groups: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(groups)))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any missing value (NaN counts as missing)."""
    return df.na.drop()


def sort_series(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.orderBy(*spec.by, spec.ts, *spec.tie)


def dedupe_keep_last(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The last row of each (series, timestamp), last by the tie columns.

    A max over a struct combines map-side, so a hot timestamp costs one row per task.
    """
    keys = [*spec.by, spec.ts]
    rest = [c for c in df.columns if c not in keys]
    order = [*spec.tie, *[c for c in rest if c not in spec.tie]]
    if not order:
        return df.dropDuplicates(keys)
    last = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def head_tail(df: DataFrame, spec: SeriesSpec, k: int = 3) -> DataFrame:
    """First and last ``k`` rows of each series, with the part they belong to.

    Each end is a row-number filter (a limit without a group) that Spark also applies before the shuffle.
    """
    order = series_order(df, spec)

    def end(part: str, by_order: list[Column]) -> DataFrame:
        if not spec.by:
            return df.orderBy(*by_order).limit(k).withColumn("part", F.lit(part))
        w = W.partitionBy(*spec.by).orderBy(*by_order)
        return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn").withColumn("part", F.lit(part))

    return end("head", order).unionByName(end("tail", [c.desc() for c in order]))


def row_positions(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with ``_idx`` and ``_len``."""
    return indexed_rows(df, spec, columns)


def step_counts(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """How often each distance (in seconds) between neighbouring timestamps occurs."""
    stepped = windowed(
        df, spec, lambda w: {"_prev": F.lag(spec.ts, 1).over(w)}, back=1, columns=[spec.ts, *spec.tie]
    )
    sec = (micros(spec.ts) - micros("_prev")) / F.lit(1e6)
    return (
        stepped.filter(F.col("_prev").isNotNull())
        .groupBy(*spec.by, sec.alias("step_seconds"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def modal_step(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Most common step of each series; the smaller one of equally common steps."""
    best = F.max(F.struct("n", (-F.col("step_seconds")).alias("neg"))).alias("_b")
    return (
        step_counts(df, spec).groupBy(*spec.by).agg(best)
        .select(*spec.by, (-F.col("_b.neg")).alias("step_seconds"))
    )


def frequency_code(seconds: Column) -> Column:
    """Name of a step; bounds are fixed values."""
    day = 86400
    return (
        F.when(seconds.isNull(), "unknown")
        .when(seconds == day, "D")
        .when(seconds == 7 * day, "W")
        .when(seconds.between(28 * day, 31 * day), "M")
        .when(seconds == 3600, "H")
        .when(seconds == 1800, "30T")
        .when(seconds == 900, "15T")
        .when(seconds.between(89 * day, 92 * day), "Q")
        .when(seconds.between(364 * day, 366 * day), "Y")
        .otherwise("irregular")
    )


def union_parts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
