"""The forecast of the best model of each series."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from seriesloom.forecast.arima import fc_arima
from seriesloom.forecast.baseline import fc_moving_average, fc_naive, fc_seasonal_naive, future_dates
from seriesloom.forecast.decomposable import fc_decomposable
from seriesloom.forecast.tree import fc_tree_recursive, train_gbt, train_random_forest
from seriesloom.functions.features import tree_features
from seriesloom.operators.joins import keyed_join
from seriesloom.operators.splits import split_ratio
from seriesloom.plans.backtest import ALL_MODELS, backtest_all
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec


def best_forecasts(series: DataFrame, spec: SeriesSpec, horizon: int = 30, freq: str = "D", period: int = 7,
                   models: Sequence[str] = ALL_MODELS, ranked: DataFrame | None = None) -> DataFrame:
    """h, ts, yhat and model: each series is forecast by the model that its back-test ranks first.

    A model is fitted only on the series that it won; only the names of the winning models reach the driver. Trees are fitted on the split of the back-test and forecast
    step by step. Series without a ranking (too short for a test part) get the naive forecast. ``ranked`` takes the place of the back-test.
    """
    by = spec.by
    rows = materialize(series.select(*by, spec.ts, *spec.tie, spec.y))
    ranked = materialize(ranked if ranked is not None else backtest_all(rows, spec, freq, period=period, models=models))
    first = materialize(ranked.where("rank = 1").select(*by, F.col("model").alias("_model")))
    if by:
        won = keyed_join(rows, first, by)
    else:
        top = first.first()
        won = rows.withColumn("_model", F.lit(top[0] if top else None).cast("string"))
    won = materialize(won.withColumn("_model", F.coalesce("_model", F.lit("naive"))))
    names = sorted(r[0] for r in won.select("_model").distinct().collect())  # one per model at most

    def trees(mine: DataFrame, fit) -> DataFrame:
        table = materialize(split_ratio(tree_features(mine, spec), spec))
        return fc_tree_recursive(fit(table), mine, spec, horizon, freq)

    make = {
        "naive": lambda d, g: fc_naive(d, spec, grid=g),
        "seasonal_naive": lambda d, g: fc_seasonal_naive(d, spec, period=period, grid=g),
        "moving_average": lambda d, g: fc_moving_average(d, spec, window=period, grid=g),
        "xgboost": lambda d, g: trees(d, lambda t: train_gbt(t, spec, "xgboost")),
        "lightgbm": lambda d, g: trees(d, lambda t: train_gbt(t, spec, "lightgbm")),
        "random_forest": lambda d, g: trees(d, lambda t: train_random_forest(t, spec)),
        "decomposable": lambda d, g: fc_decomposable(d, spec, g),
        "arima": lambda d, g: fc_arima(d, spec, horizon, freq),
    }
    parts = []
    for name in names:
        mine = won.where(F.col("_model") == name).drop("_model")
        out = make[name](mine, future_dates(mine, spec, horizon, freq))
        parts.append(out.select(*by, F.col("h").cast("int").alias("h"), spec.ts, F.col("yhat").cast("double").alias("yhat"), F.lit(name).alias("model")))
    if not parts:
        return future_dates(rows, spec, horizon, freq).select(*by, F.col("h").cast("int").alias("h"), spec.ts, F.lit(None).cast("double").alias("yhat"), F.lit(None).cast("string").alias("model"))
    return reduce(DataFrame.unionByName, parts)
