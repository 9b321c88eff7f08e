"""Alerts, model suggestions and model scores from a table of series statistics."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values: (model, category, least number of rows, takes features, takes groups).
MODELS = (
    ("naive", "baseline", 1, False, False),
    ("seasonal_naive", "baseline", 2, False, False),
    ("arima", "statistical", 30, False, False),
    ("prophet", "statistical", 50, True, False),
    ("xgboost", "machine_learning", 100, True, True),
    ("lightgbm", "machine_learning", 100, True, True),
    ("lstm", "deep_learning", 1000, True, True),
)


def _rows_of(table: DataFrame, keep: Sequence[str], rules: Sequence[tuple[Column, Column]]) -> DataFrame:
    found = F.array(*[F.when(cond, value) for cond, value in rules])
    return table.select(*keep, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_r")).select(*keep, "_r.*")


def quality_alerts(report: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (level, code, value). Needs columns missing_pct, outlier_pct, count and adf_stationary."""
    def alert(level: str, code: str, value: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), value.cast("double").alias("value"))

    miss, out, n = F.col("missing_pct"), F.col("outlier_pct"), F.col("count")
    return _rows_of(report, by, [
        (miss > 10, alert("error", "many_missing_values", miss)),
        ((miss > 5) & (miss <= 10), alert("warning", "missing_values", miss)),
        (~F.col("adf_stationary"), alert("info", "not_stationary", F.lit(None))),
        (out > 5, alert("warning", "many_outliers", out)),
        (n < 30, alert("warning", "few_rows", n)),
    ])


def model_suggestions(report: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (priority, model, reason). Needs columns detected, adf_stationary and count."""
    def pick(priority: int, model: str, reason: str) -> Column:
        return F.struct(F.lit(priority).alias("priority"), F.lit(model).alias("model"), F.lit(reason).alias("reason"))

    seasonal, steady, large = F.col("detected"), F.coalesce(F.col("adf_stationary"), F.lit(False)), F.col("count") > 100
    return _rows_of(report, by, [
        (seasonal, pick(1, "Prophet", "seasonal")),
        (steady | ~seasonal, pick(2, "ARIMA", "stationary_or_not_seasonal")),
        (large, pick(3, "XGBoost", "enough_rows")),
        (large, pick(4, "LightGBM", "enough_rows")),
        (F.lit(True), pick(5, "Naive", "baseline")),
        (seasonal, pick(6, "Seasonal Naive", "seasonal_baseline")),
    ])


def model_scoring(report: DataFrame, by: Sequence[str], has_features: bool = False, has_groups: bool = False) -> DataFrame:
    """Score of every known model for every series. Needs columns count, detected and stationary.

    The seven models are exploded from a literal, one row per series and model. Points are fixed values.
    """
    entry = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(c).alias("category"), F.lit(k).alias("min_rows"),
                 F.lit(f).alias("takes_features"), F.lit(g).alias("takes_groups"))
        for m, c, k, f, g in MODELS
    ])
    t = report.select(*by, "count", "detected", "stationary", F.explode(entry).alias("_m")).select(
        *by, "count", "detected", "stationary", "_m.*"
    )
    m, n = F.col("model"), F.col("count")
    season = F.when(
        F.col("detected"),
        F.when(m.isin("seasonal_naive", "arima", "prophet"), 2.0).when(m.isin("xgboost", "lightgbm", "lstm"), 1.0).otherwise(0.0),
    ).otherwise(0.0)
    features = F.when(F.col("takes_features"), 2.0 if has_features else 0.0).otherwise(0.0 if has_features else 0.5)
    groups = F.when(F.col("takes_groups"), 1.5).otherwise(-1.0) if has_groups else F.lit(0.0)
    size = (
        F.when(m.isin("arima", "prophet") & n.between(50, 500), 1.5)
        .when(m.isin("xgboost", "lightgbm") & (n >= 200), 1.5)
        .when((m == "lstm") & (n >= 1000), 2.0)
        .when((m == "lstm") & (n < 500), -2.0)
        .otherwise(0.0)
    )
    steady = F.when((m == "arima") & ~F.col("stationary"), 1.0).otherwise(0.0)
    base = F.when(m.isin("naive", "seasonal_naive"), 1.0).otherwise(0.0)
    points = F.when(n < F.col("min_rows"), 0.0).otherwise(6.0 + season + features + groups + size + steady + base)
    return t.select(*by, "model", "category", points.alias("score"), (points >= 7.0).alias("recommended"))
