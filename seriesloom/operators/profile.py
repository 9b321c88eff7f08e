"""Describing series: ranges, moments, trend, histogram, box plots, gaps."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesloom.operators.clean import missing_summary
from seriesloom.operators.index import IDX, LEN, order_series
from seriesloom.operators.joins import attach, series_join, side_join
from seriesloom.operators.outliers import iqr_bounds
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.operators.series import frequency_code, modal_step
from seriesloom.spec import SeriesSpec


def present(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows whose target is there."""
    y = F.col(spec.y).cast("double")
    return df.filter(y.isNotNull() & ~F.isnan(y))


def merge_stats(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put two one-row-per-series tables side by side."""
    return series_join(left, right, by)


def date_range_freq(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    ends = df.groupBy(*spec.by).agg(F.min(spec.ts).alias("start"), F.max(spec.ts).alias("end"))
    out = merge_stats(ends, modal_step(df, spec), spec.by)
    days = F.floor(F.timestamp_diff("SECOND", F.col("start"), F.col("end")) / 86400)
    return out.select(*spec.by, "start", "end", days.cast("long").alias("total_days"),
                      frequency_code(F.col("step_seconds")).alias("frequency"))


def describe_target(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    rows = present(df, spec)
    y = F.col(spec.y).cast("double")
    flat = rows.groupBy(*spec.by).agg(
        F.count(y).alias("count"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("min"),
        F.max(y).alias("max"), F.skewness(y).alias("skewness"), F.kurtosis(y).alias("kurtosis"),
    )
    q = exact_quantiles(rows, spec.y, [0.25, 0.5, 0.75], spec.by, ["q25", "median", "q75"])
    return merge_stats(flat, q, spec.by)


def numeric_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per column from a single aggregate: n, n_null, min, max, mean, population deviation."""
    columns = list(columns)
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs.append(
            F.struct(
                F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("n_null"),
                F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
            ).alias(f"_c{i}")
        )
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.explode(F.array(*[f"_c{i}" for i in range(len(columns))])).alias("_s")).select(*by, "_s.*")


def zero_neg_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    columns = list(columns)
    aggs = [
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c) == 0).alias("n_zero"), F.count_if(F.col(c) < 0).alias("n_negative")).alias(f"_c{i}")
        for i, c in enumerate(columns)
    ]
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.explode(F.array(*[f"_c{i}" for i in range(len(columns))])).alias("_s")).select(*by, "_s.*")


def trend_linear(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Least squares on the row position; a slope below 1 % of the deviation counts as stable."""
    rows = order_series(present(df, spec), spec, [spec.y]).indexed()
    x, y = F.col(IDX).cast("double"), F.col(spec.y).cast("double")
    fit = rows.groupBy(*spec.by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"),
        F.stddev_pop(y).alias("_sd"),
    )
    way = (
        F.when(F.col("slope").isNull(), None).when(F.abs("slope") < 0.01 * F.col("_sd"), "stable")
        .when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    )
    return fit.select(*spec.by, "slope", "intercept", "r_squared", way.alias("direction"))


def histogram30(df: DataFrame, spec: SeriesSpec, bins: int = 30) -> DataFrame:
    """Equal bins from min to max, the last one closed; a constant series gets a range of one."""
    rows = present(df, spec)
    y = F.col(spec.y).cast("double")
    ends = rows.groupBy(*spec.by).agg(F.min(y).alias("_a"), F.max(y).alias("_b")).filter(F.col("_a").isNotNull())
    flat = F.col("_a") == F.col("_b")
    ends = ends.select(*spec.by, F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_a"),
                       F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_b"))
    placed = attach(rows.select(*spec.by, y.alias("_v")), ends, spec.by)
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.least(F.floor((F.col("_v") - F.col("_a")) / width), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*spec.by, at.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    frame = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = side_join(frame, counts, [*spec.by, "bin"])
    return out.select(*spec.by, "bin", (F.col("_a") + F.col("bin") * width).alias("bin_start"),
                      (F.col("_a") + (F.col("bin") + 1) * width).alias("bin_end"), F.coalesce("_n", F.lit(0)).alias("n"))


def _five(rows: DataFrame, y: str, by: Sequence[str]) -> DataFrame:
    ends = rows.groupBy(*by).agg(F.min(y).alias("min"), F.max(y).alias("max"))
    q = exact_quantiles(rows, y, [0.25, 0.5, 0.75], by, ["q1", "median", "q3"])
    return merge_stats(ends, q, by).select(*by, "min", "q1", "median", "q3", "max")


def first_outliers(df: DataFrame, spec: SeriesSpec, k: int, threshold: float = 1.5) -> DataFrame:
    """The first ``k`` IQR outliers of each series, with their 0-based place among the present rows.

    The row-number filter, or without a group the limit, is applied before the shuffle as well, so each task sends at most k rows per series.
    """
    rows = present(df, spec)
    placed = attach(order_series(rows, spec).indexed(), iqr_bounds(rows, spec, threshold), spec.by)
    out = placed.filter((F.col(spec.y) < F.col("lower")) | (F.col(spec.y) > F.col("upper")))
    if not spec.by:
        out = out.orderBy(IDX).limit(k)
    w = W.partitionBy(*(spec.by or [F.lit(0)])).orderBy(IDX)
    return (
        out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
        .select(*spec.by, F.col("_rn").alias("rank"), F.col(IDX).alias("position"), spec.ts, spec.y)
    )


def outlier_positions(df: DataFrame, spec: SeriesSpec, k: int = 100) -> DataFrame:
    return first_outliers(df, spec, k)


def boxplot_overall(df: DataFrame, spec: SeriesSpec, k: int = 50) -> DataFrame:
    """Five numbers per series and the first ``k`` outliers in time order."""
    rows = present(df, spec)
    some = first_outliers(df, spec, k).groupBy(*spec.by).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col(spec.y).alias("v")))).alias("_o")
    )
    if not spec.by:
        some = some.select(F.coalesce("_o", F.array()).alias("_o"))
    out = series_join(_five(rows, spec.y, spec.by), some, spec.by)
    empty = F.array().cast("array<double>")
    return out.withColumn("outliers", F.coalesce(F.transform("_o", lambda s: s["v"].cast("double")), empty)).drop("_o")


def boxplot_by_month(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    rows = present(df, spec).withColumn("month", F.date_format(spec.ts, "MMM"))
    return _five(rows, spec.y, [*spec.by, "month"])


def outlier_share(df: DataFrame, spec: SeriesSpec, threshold: float = 1.5) -> DataFrame:
    rows = present(df, spec)
    placed = attach(rows, iqr_bounds(rows, spec, threshold), spec.by)
    hit = (F.col(spec.y) < F.col("lower")) | (F.col(spec.y) > F.col("upper"))
    return placed.groupBy(*spec.by).agg(
        F.count_if(hit).alias("n_outliers"), (F.count_if(hit) / F.count(F.lit(1)) * 100).alias("outlier_pct")
    )


def group_profile(df: DataFrame, spec: SeriesSpec, freq: str = "D") -> DataFrame:
    """Moments, quantiles, outlier share and missing counts of each series in one row."""
    out = merge_stats(describe_target(df, spec), outlier_share(df, spec), spec.by)
    return merge_stats(out, missing_summary(df, spec, freq), spec.by)
