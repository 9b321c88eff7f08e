"""Value transformations."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.operators.joins import attach, number_or_null
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec


def _put(df: DataFrame, columns: Sequence[str], y: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(c) if c == y else F.col(c) for c in columns])


def tx_log1p(df: DataFrame, column: str) -> DataFrame:
    return _put(df, df.columns, column, F.log1p(column))


def tx_signed_sqrt(df: DataFrame, column: str) -> DataFrame:
    return _put(df, df.columns, column, F.sqrt(F.abs(column)) * F.signum(column))


def tx_box_cox(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """ln(1+x), only for series whose values are all positive."""
    gate = df.groupBy(*spec.by).agg((F.min(spec.y) > 0).alias("_pos"))
    out = attach(df, gate, spec.by)
    return _put(out, df.columns, spec.y, F.when(F.col("_pos"), F.log1p(spec.y)).otherwise(F.col(spec.y)))


def tx_standardize(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Zero mean and unit population deviation; a constant series becomes 0, NaN becomes NULL."""
    y = number_or_null(spec.y)
    stats = df.groupBy(*spec.by).agg(F.avg(y).alias("_mu"), F.stddev_pop(y).alias("_sd"))
    out = attach(df, stats, spec.by)
    scale = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    return _put(out, df.columns, spec.y, (y - F.col("_mu")) / scale)


def tx_minmax(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """To [0, 1]; a series without range becomes 0, NaN becomes NULL."""
    y = number_or_null(spec.y)
    stats = df.groupBy(*spec.by).agg(F.min(y).alias("_a"), F.max(y).alias("_b"))
    out = attach(df, stats, spec.by)
    width = F.col("_b") - F.col("_a")
    return _put(out, df.columns, spec.y, (y - F.col("_a")) / F.when(width == 0, 1.0).otherwise(width))


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The power transform of Yeo and Johnson (2000) for a given lambda."""
    eps = 1e-9
    up = F.when(F.abs(lam) < eps, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(lam - 2) < eps, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_lambda(df: DataFrame, spec: SeriesSpec, rounds: int = 4) -> DataFrame:
    """Lambda of greatest likelihood per series: a grid of 21 values, narrowed tenfold per round."""
    y = F.col(spec.y).cast("double")
    clean = df.select(*spec.by, y.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    best = clean.groupBy(*spec.by).agg(F.lit(0.0).alias("_l0"))
    step = 0.5
    for _ in range(rounds):
        rows = attach(clean, best, spec.by)
        grid = [round((i - 10) * step, 10) for i in range(21)]
        x = F.col("_x")
        aggs = [F.var_pop(yeo_johnson(x, F.col("_l0") + g)).alias(f"_v{i}") for i, g in enumerate(grid)]
        fits = rows.groupBy(*spec.by).agg(
            *aggs, F.count(F.lit(1)).alias("_n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("_j"), F.max("_l0").alias("_l0")
        )
        ll = [
            F.struct((-F.col("_n") / 2 * F.log(F.col(f"_v{i}")) + (F.col("_l0") + g - 1) * F.col("_j")).alias("ll"),
                     (F.col("_l0") + g).alias("lam"))
            for i, g in enumerate(grid)
        ]
        usable = F.filter(F.array(*ll), lambda s: s["ll"].isNotNull() & ~F.isnan(s["ll"]))
        best = materialize(fits.select(*spec.by, F.coalesce(F.array_max(usable)["lam"], F.lit(1.0)).alias("_l0")))
        step /= 10
    return best.withColumnRenamed("_l0", "lambda")


def tx_yeo_johnson(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Power transform with fitted lambda, then standardised."""
    lam = yeo_johnson_lambda(df, spec).withColumnRenamed("lambda", "_lam")
    out = attach(df, lam, spec.by)
    out = _put(out, df.columns, spec.y, yeo_johnson(F.col(spec.y).cast("double"), F.col("_lam")))
    return tx_standardize(out, spec)


def transform(df: DataFrame, spec: SeriesSpec, method: str = "none") -> DataFrame:
    """Transform the target by method name."""
    name = method.replace("-", "_")
    if name == "none":
        return df
    if name in ("log", "log1p"):
        return tx_log1p(df, spec.y)
    if name == "sqrt":
        return tx_signed_sqrt(df, spec.y)
    by_name = {
        "box_cox": tx_box_cox, "yeo_johnson": tx_yeo_johnson, "standardize": tx_standardize,
        "normalize": tx_minmax, "minmax": tx_minmax,
    }
    if name not in by_name:
        raise ValueError(f"unknown transformation {method!r}")
    return by_name[name](df, spec)
