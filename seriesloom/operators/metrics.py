"""Forecast errors per series and model."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.operators.index import windowed
from seriesloom.operators.joins import number_or_null, side_join
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.spec import SeriesSpec

ACTUAL, PRED = "actual", "pred"
METRICS = ("mae", "rmse", "mape", "smape", "r2", "medae", "mase")


def align_actual_pred(actuals: DataFrame, preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of actual and predicted value that share the keys (series and timestamp). NULL groups meet; missing values and NaN make no pair."""
    there = [number_or_null(c).isNotNull() for c in (ACTUAL, PRED)]
    return side_join(actuals, preds, keys, "inner").filter(there[0] & there[1])


def residuals(df: DataFrame) -> DataFrame:
    return df.withColumn("residual", F.col(ACTUAL) - F.col(PRED))


def _e() -> Column:
    return F.col(ACTUAL) - F.col(PRED)


def mae_expr() -> Column:
    return F.avg(F.abs(_e()))


def rmse_expr() -> Column:
    return F.sqrt(F.avg(_e() * _e()))


def r2_expr() -> Column:
    """1 - SSE/SST; a constant target gives 1 for a perfect fit and 0 otherwise; one row gives NULL."""
    n = F.count(F.lit(1))
    sse, sst = F.sum(_e() * _e()), F.var_pop(ACTUAL) * n
    return F.when(n < 2, None).when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - sse / sst)


def mape_expr() -> Column:
    return F.coalesce(F.avg(F.when(F.col(ACTUAL) != 0, F.abs(_e() / F.col(ACTUAL)))) * 100, F.lit(0.0))


def smape_expr() -> Column:
    size = F.abs(ACTUAL) + F.abs(PRED)
    return F.coalesce(F.avg(F.when(size != 0, 2 * F.abs(_e()) / size)) * 100, F.lit(0.0))


def _one(df: DataFrame, by: Sequence[str], name: str, expr: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), expr.alias(name))


def metric_mae(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return _one(df, by, "mae", mae_expr())


def metric_rmse(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return _one(df, by, "rmse", rmse_expr())


def metric_r2(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return _one(df, by, "r2", r2_expr())


def metric_mape(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return _one(df, by, "mape", mape_expr())


def metric_smape(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return _one(df, by, "smape", smape_expr())


def metric_medae(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return exact_quantiles(df.withColumn("_ae", F.abs(_e())), "_ae", [0.5], by, ["medae"])


def naive_scale(train: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean absolute first difference of the train rows."""
    d = windowed(train, spec, lambda w: {"_d": F.abs(F.col(spec.y) - F.lag(spec.y, 1).over(w))}, back=1)
    return d.groupBy(*spec.by).agg(F.avg("_d").alias("naive_error"))


def metric_mase(df: DataFrame, train: DataFrame, spec: SeriesSpec, by: Sequence[str]) -> DataFrame:
    """MAE over the naive scale of the train part; 0 where the scale is 0 or undefined."""
    return _with_mase(_one(df, by, "mae", mae_expr()), train, spec).select(*by, "n", "mase")


def _with_mase(scores: DataFrame, train: DataFrame, spec: SeriesSpec) -> DataFrame:
    scale = naive_scale(train, spec)
    if spec.by:
        out = side_join(scores, scale, spec.by)
    else:
        row = scale.first()
        out = scores.withColumn("naive_error", F.lit(row[0] if row else None).cast("double"))
    ratio = F.col("mae") / F.nullif(F.col("naive_error"), F.lit(0.0))
    return out.withColumn("mase", F.coalesce(ratio, F.lit(0.0))).drop("naive_error")


def fit_diagnostics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correlation and ratio of deviations; 0 and 1 where either side is constant."""
    sa, sp = F.stddev_pop(ACTUAL), F.stddev_pop(PRED)
    usable = (F.count(F.lit(1)) > 1) & (sa > 0) & (sp > 0)
    return df.groupBy(*by).agg(
        F.when(usable, F.covar_pop(ACTUAL, PRED) / F.nullif(sa * sp, F.lit(0.0))).otherwise(0.0).alias("correlation"),
        F.when(usable, sp / sa).otherwise(1.0).alias("std_ratio"),
    )


def score(df: DataFrame, train: DataFrame, spec: SeriesSpec, by: Sequence[str]) -> DataFrame:
    """All seven metrics, one row per ``by``. ``by`` contains the group columns."""
    by = list(by)
    flat = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), mae_expr().alias("mae"), rmse_expr().alias("rmse"), mape_expr().alias("mape"),
        smape_expr().alias("smape"), r2_expr().alias("r2"),
    )
    return _with_mase(side_join(flat, metric_medae(df, by), by), train, spec).select(*by, "n", *METRICS)
