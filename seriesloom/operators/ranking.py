"""Ranking models and summing up an evaluation. Input: one row per model (and series)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesloom.operators.joins import number_or_null
from seriesloom.operators.metrics import METRICS


def _order(metric: str) -> Column:
    c = number_or_null(metric)
    return c.desc_nulls_last() if metric == "r2" else c.asc_nulls_last()


def rank_models(scores: DataFrame, metric: str = "rmse", by: Sequence[str] = (), model: str = "model") -> DataFrame:
    """Position of each model within ``by``; missing metrics and NaN rank last, names break ties.

    A partition holds one row per model, so its size is the number of models.
    """
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(_order(metric), model)
    return scores.withColumn("rank", F.row_number().over(w))


def average_over_groups(scores: DataFrame, model: str = "model", time: str | None = "training_time") -> DataFrame:
    aggs = [F.avg(number_or_null(m)).alias(m) for m in METRICS if m in scores.columns]
    if time and time in scores.columns:
        aggs.append(F.sum(time).alias(time))
    return scores.groupBy(model).agg(F.count(F.lit(1)).alias("n_series"), *aggs)


def rank_grouped(scores: DataFrame, metric: str = "rmse", model: str = "model") -> DataFrame:
    """Models ranked by their metric averaged over the series."""
    return rank_models(average_over_groups(scores, model), metric, (), model)


def eval_summary(ranked: DataFrame, metric: str = "rmse", model: str = "model") -> DataFrame:
    """One row: totals, the best model, and averages that leave zeros out."""
    count = F.sum("n_series") if "n_series" in ranked.columns else F.count(F.lit(1))
    aggs = [
        count.alias("total_models"),
        F.max(F.when(F.col("rank") == 1, F.col(model))).alias("best_model"),
        F.max(F.when(F.col("rank") == 1, F.col(metric))).alias("best_value"),
    ]
    aggs += [F.coalesce(F.avg(F.nullif(number_or_null(m), F.lit(0.0))), F.lit(0.0)).alias(f"avg_{m}") for m in METRICS if m in ranked.columns]
    if "training_time" in ranked.columns:
        aggs.append(F.sum("training_time").alias("total_training_time"))
    return ranked.agg(*aggs)


def eval_advice(ranked: DataFrame, metric: str = "rmse", model: str = "model") -> DataFrame:
    """Remarks on a ranking as rows (rule, value); thresholds are fixed values."""
    first, second = F.col("rank") == 1, F.col("rank") == 2
    top = ranked.agg(
        F.max(F.when(first, F.col(model))).alias("best"),
        F.max(F.when(first, F.col(metric))).alias("m1"),
        F.max(F.when(second, F.col(metric))).alias("m2"),
        F.max(F.when(first, F.col("mape"))).alias("mape"),
        F.max(F.when(first, F.col("r2"))).alias("r2"),
    )
    if metric == "r2":
        gap = F.abs(F.col("m1") - F.col("m2")) / F.greatest(F.abs("m1"), F.lit(0.01)) * 100
    else:
        gap = F.when(F.col("m2") > 0, F.abs(F.col("m1") - F.col("m2")) / F.col("m2") * 100)
    rules = [
        ("best_model", F.col("best").isNotNull(), F.col("m1")),
        ("top_two_are_close", gap < 5, gap),
        ("mape_excellent", F.col("mape") < 5, F.col("mape")),
        ("mape_good", (F.col("mape") >= 5) & (F.col("mape") < 10), F.col("mape")),
        ("mape_high", F.col("mape") > 20, F.col("mape")),
        ("r2_low", F.col("r2") < 0.5, F.col("r2")),
        ("r2_excellent", F.col("r2") > 0.9, F.col("r2")),
    ]
    found = F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), v.alias("value"))) for n, c, v in rules])
    return top.select("best", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_r")).select(
        F.col("best").alias("best_model"), "_r.rule", "_r.value"
    )
