"""Back-test: build the series, split, forecast the test part, score and rank."""

from __future__ import annotations

from time import perf_counter
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from seriesloom.forecast.arima import fc_arima
from seriesloom.forecast.baseline import fc_moving_average, fc_naive, fc_seasonal_naive
from seriesloom.forecast.decomposable import fc_decomposable
from seriesloom.forecast.tree import backtest_tree, train_gbt, train_random_forest
from seriesloom.functions.features import tree_features
from seriesloom.operators.index import IDX, LEN, indexed_rows
from seriesloom.operators.joins import side_join
from seriesloom.operators.metrics import align_actual_pred, score
from seriesloom.operators.ranking import rank_models
from seriesloom.operators.splits import RATIOS, split_ratio
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec


def split_with_steps(series: DataFrame, spec: SeriesSpec, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """Split rows that keep their position, and ``h``: the number of steps past the last known row."""
    rows = split_ratio(indexed_rows(series, spec), spec, ratios)
    known = sum((F.floor(F.col(LEN) * F.lit(float(r))) for r in ratios[:2]), F.lit(0))
    return rows.withColumn("h", (F.col(IDX) - known + 1).cast("int"))


def backtest_baselines(series: DataFrame, spec: SeriesSpec, ratios: Sequence[float] = RATIOS, period: int = 7,
                       models: Sequence[str] = ("naive", "seasonal_naive", "moving_average")) -> DataFrame:
    """Scores of the baseline models on the test part, ranked by RMSE within each series.

    Forecasts start from all rows before the test part; MASE scales by the train part.
    """
    split = materialize(split_with_steps(series, spec, ratios))
    train = split.filter(F.col("split") == "train")
    known = split.filter(F.col("split") != "test")
    actual = split.filter(F.col("split") == "test").select(*spec.by, spec.ts, F.col(spec.y).cast("double").alias("actual"))
    grid = split.filter(F.col("split") == "test").select(*spec.by, "h", spec.ts)
    make = {
        "naive": lambda: fc_naive(known, spec, grid=grid),
        "seasonal_naive": lambda: fc_seasonal_naive(known, spec, period=period, grid=grid),
        "moving_average": lambda: fc_moving_average(known, spec, window=period, grid=grid),
    }
    parts = [make[m]().select(*spec.by, spec.ts, F.col("yhat").alias("pred")).withColumn("model", F.lit(m)) for m in models]
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    pairs = materialize(align_actual_pred(actual, preds, [*spec.by, spec.ts]))
    return rank_models(score(pairs, train, spec, [*spec.by, "model"]), "rmse", spec.by)


#: All models that ``backtest_all`` knows.
ALL_MODELS = ("naive", "seasonal_naive", "moving_average", "xgboost", "lightgbm", "random_forest", "decomposable", "arima")


def backtest_all(series: DataFrame, spec: SeriesSpec, freq: str = "D", ratios: Sequence[float] = RATIOS, period: int = 7,
                 models: Sequence[str] = ALL_MODELS) -> DataFrame:
    """Scores of all kinds of models over one split, ranked by RMSE within each series, with the measured ``training_time`` in seconds.

    Baselines, the decomposable model and ARIMA start from all rows before the test part and forecast it as a whole; trees are fitted on the train
    part, stopped by the val part, and predict each test row from the rows before it. Each model's predictions are written once, and the time that
    takes, fit included, counts as its training time. Series that a model has no values for have no row for it.
    """
    split = materialize(split_with_steps(series, spec, ratios))
    train, known = split.filter(F.col("split") == "train"), split.filter(F.col("split") != "test")
    test = split.filter(F.col("split") == "test")
    actual = test.select(*spec.by, spec.ts, F.col(spec.y).cast("double").alias("actual"))
    grid = test.select(*spec.by, "h", spec.ts)
    plain = known.drop("split", "h", IDX, LEN)
    made: dict[str, DataFrame] = {}

    def features() -> DataFrame:
        if "table" not in made:
            made["table"] = materialize(tree_features(split.drop("h"), spec))
        return made["table"]

    def by_step() -> DataFrame:
        longest = grid.agg(F.max("h")).first()[0] or 1
        steps = fc_arima(plain, spec, int(longest), freq).select(*spec.by, "h", "yhat")
        return side_join(grid, steps, [*spec.by, "h"])

    make = {
        "naive": lambda: fc_naive(known, spec, grid=grid),
        "seasonal_naive": lambda: fc_seasonal_naive(known, spec, period=period, grid=grid),
        "moving_average": lambda: fc_moving_average(known, spec, window=period, grid=grid),
        "xgboost": lambda: backtest_tree(train_gbt(features(), spec, "xgboost"), features(), spec),
        "lightgbm": lambda: backtest_tree(train_gbt(features(), spec, "lightgbm"), features(), spec),
        "random_forest": lambda: backtest_tree(train_random_forest(features(), spec), features(), spec),
        "decomposable": lambda: fc_decomposable(plain, spec, grid),
        "arima": by_step,
    }
    preds, seconds = None, {}
    if any(m in ("xgboost", "lightgbm", "random_forest") for m in models):
        features()
    for m in models:
        start = perf_counter()
        out = make[m]()
        value = "pred" if "pred" in out.columns else "yhat"
        part = materialize(out.select(*spec.by, spec.ts, F.col(value).cast("double").alias("pred"), F.lit(m).alias("model")))
        seconds[m] = perf_counter() - start
        preds = part if preds is None else preds.unionByName(part)
    pairs = materialize(align_actual_pred(actual, preds, [*spec.by, spec.ts]))
    took = F.element_at(F.create_map(*[F.lit(x) for kv in seconds.items() for x in kv]), F.col("model"))
    scores = score(pairs, train, spec, [*spec.by, "model"]).withColumn("training_time", took)
    return rank_models(scores, "rmse", spec.by)
