"""Tree ensembles over lag, rolling and calendar features: one model for all series.

Spark ML's boosted trees stand in for both boosted-tree presets. They have no L1 or L2
penalty, and their importances are shares of impurity gain rather than split counts.
The series is known to the model by the mean and deviation of its train rows, so no
list of series is ever gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seriesloom.forecast.baseline import future_dates, last_rows
from seriesloom.functions.features import ewm_reach, target_delta, tree_date_features
from seriesloom.operators.clean import add_steps
from seriesloom.operators.exog import carry_exog
from seriesloom.operators.index import IDX, LEN
from seriesloom.operators.joins import attach, series_join
from seriesloom.operators.profile import present
from seriesloom.session import ensure_checkpoint_dir, materialize
from seriesloom.spec import SeriesSpec

# Defaults of the two presets.
COMMON = {"maxDepth": 8, "stepSize": 0.05, "maxIter": 500, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
PRESETS = {"xgboost": {"minInstancesPerNode": 3}, "lightgbm": {"minInstancesPerNode": 20}}
#: Fixed value: rounds without a better validation error after which boosting stops.
PATIENCE = 20
_STEPS_PER_PLAN = 6


@dataclass
class TreeModel:
    model: Model
    features: list[str]
    delta: bool
    levels: DataFrame | None
    lags: Sequence[int] = (1, 7, 14, 28)
    windows: Sequence[int] = (7, 14, 30)
    span: int | None = 7
    exog: list[str] = field(default_factory=list)

    def apply(self, rows: DataFrame) -> DataFrame:
        """Adds ``pred``, on the level of the target."""
        # Rows without all features are expected to be gone; a filter here would be pushed down
        # through every earlier step of a recursive forecast and compute it again.
        ready = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(rows)
        out = self.model.transform(ready)
        level = F.col("prediction") + F.col("lag_1") if self.delta else F.col("prediction")
        return out.withColumn("pred", level).drop("_x", "prediction")


def usable_features(df: DataFrame, spec: SeriesSpec, skip: Sequence[str] = ()) -> list[str]:
    """Numeric and boolean columns but the target, dates, keys and ``skip``."""
    kinds = (T.NumericType, T.BooleanType)
    barred = {spec.y, spec.ts, "date", "h", IDX, LEN, *spec.by, *spec.tie, *skip}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in barred and not f.name.endswith("_date")]


def series_levels(train: DataFrame, spec: SeriesSpec) -> DataFrame:
    return train.groupBy(*spec.by).agg(
        F.avg(spec.y).alias("series_mean"), F.coalesce(F.stddev_samp(spec.y), F.lit(0.0)).alias("series_std")
    )


def boost_with_patience(settings: dict, train: DataFrame, val: DataFrame, patience: int = PATIENCE) -> Model:
    """Boosted trees up to the round of least validation error, found when ``patience`` rounds have passed without a better one.

    A run with more rounds begins with the very same trees, so rising numbers of rounds are fitted and
    the errors of all their stages read in one pass, until the best stage lies far enough before the end.
    """
    most = settings["maxIter"]
    rounds = min(most, 2 * patience)
    while True:
        model = GBTRegressor(**{**settings, "maxIter": rounds}).fit(train)
        errors = model.evaluateEachIteration(val, "squared")
        best = stop = 0
        while stop < len(errors) and stop - best < patience:
            best = stop if errors[stop] < errors[best] else best
            stop += 1
        best += 1
        if stop - best + 1 >= patience or rounds == most:
            break
        rounds = min(most, 2 * rounds)
    return model if best == rounds else GBTRegressor(**{**settings, "maxIter": best}).fit(train)


def _fit(fit, features: DataFrame, spec: SeriesSpec, split: str, delta: bool, **made) -> TreeModel:
    """``fit`` gets the train rows and the val rows (or None) with the columns ``_x`` and ``_label``."""
    ensure_checkpoint_dir(features.sparkSession)
    levels = None
    if spec.by:
        levels = materialize(series_levels(features.filter(F.col(split) == "train"), spec))
        features = attach(features, levels, spec.by)
    names = usable_features(features, spec, [split])
    delta = delta and "lag_1" in names
    rows = target_delta(features, spec, "_label") if delta else features.withColumn("_label", F.col(spec.y).cast("double"))
    rows = rows.filter(F.col(split).isin("train", "val")).na.drop(subset=[*names, "_label"])
    ready = VectorAssembler(inputCols=names, outputCol="_x").transform(rows).select("_x", "_label", (F.col(split) == "val").alias("_val"))
    ready = materialize(ready)
    val = ready.filter("_val").drop("_val")
    return TreeModel(fit(ready.filter("NOT _val").drop("_val"), None if val.isEmpty() else val), names, delta, levels, **made)


def train_gbt(features: DataFrame, spec: SeriesSpec, preset: str = "xgboost", split: str = "split", delta: bool = True,
              made: dict | None = None, **params) -> TreeModel:
    """Boosted trees on the train rows; the val rows stop the boosting (see ``boost_with_patience``), without any all rounds are run.

    ``features`` is the whole labelled table, with features built before the split.
    ``made`` tells how its lag and window columns were made, for recursive forecasts.
    """
    settings = {**COMMON, **PRESETS[preset], **params, "featuresCol": "_x", "labelCol": "_label"}

    def fit(train: DataFrame, val: DataFrame | None) -> Model:
        return boost_with_patience(settings, train, val) if val is not None else GBTRegressor(**settings).fit(train)

    return _fit(fit, features, spec, split, delta, **(made or {}))


def train_random_forest(features: DataFrame, spec: SeriesSpec, split: str = "split", delta: bool = True,
                        made: dict | None = None, **params) -> TreeModel:
    settings = {"maxDepth": 8, "numTrees": 100, "seed": 42, **params, "featuresCol": "_x", "labelCol": "_label"}
    return _fit(lambda train, _: RandomForestRegressor(**settings).fit(train), features, spec, split, delta, **(made or {}))


def feature_importance(model: TreeModel, spark) -> DataFrame:
    """Feature names by falling importance: one row per feature of the model."""
    scores = [(n, float(v)) for n, v in zip(model.features, model.model.featureImportances.toArray())]
    return spark.createDataFrame(scores, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def backtest_tree(model: TreeModel, features: DataFrame, spec: SeriesSpec, split: str = "split") -> DataFrame:
    """One-step predictions of the test rows, from the features of the whole series."""
    rows = features.filter(F.col(split) == "test").na.drop(subset=[c for c in model.features if c in features.columns])
    if model.levels is not None:
        rows = attach(rows, model.levels, spec.by)
    return model.apply(rows).select(*spec.by, spec.ts, F.col(spec.y).cast("double").alias("actual"), "pred")


def _squares_around(values: Column, mean: Column) -> Column:
    return F.aggregate(F.transform(values, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)


def _tail_columns(tail: Column, lags: Sequence[int], windows: Sequence[int], span: int | None) -> dict[str, Column]:
    out = {f"lag_{k}": F.try_element_at(tail, F.lit(-k)) for k in lags}
    for n in windows:
        part = F.slice(tail, -n, n)
        mean = F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / n
        out[f"rolling_mean_{n}"], out[f"rolling_std_{n}"] = mean, F.sqrt(_squares_around(part, mean) / (n - 1))
    if span:
        r = 1 - 2 / (span + 1)
        newest = F.reverse(tail)
        num = F.aggregate(F.transform(newest, lambda v, i: v * F.pow(F.lit(r), i)), F.lit(0.0), lambda a, v: a + v)
        den = F.aggregate(F.transform(newest, lambda v, i: F.pow(F.lit(r), i)), F.lit(0.0), lambda a, v: a + v)
        out[f"ewm_{span}"] = num / den
    return out


def fc_tree_recursive(model: TreeModel, history: DataFrame, spec: SeriesSpec, horizon: int = 30, freq: str = "D",
                      exog: DataFrame | None = None) -> DataFrame:
    """Forecast step by step, each prediction feeding the features of the next.

    The state is one row per series with the few last values as an array, so a step is a
    projection without a shuffle. The plan is cut every few steps. ``exog`` holds the
    regressors of the model on the future grid (series, h, columns); without it they are
    carried over from the history (``carry_exog``). Series too short for the widest window have no values, and say so in ``reason``.
    """
    deepest = max(*model.lags, *model.windows, 1)
    reach = max(deepest, ewm_reach(model.span) if model.span else 1)
    order = F.sort_array(F.collect_list(F.struct("pos", F.col(spec.y).cast("double").alias("v"))))
    clean = present(history, spec).select(*spec.by, spec.ts, *spec.tie, spec.y)
    state = last_rows(clean, spec, reach).groupBy(*spec.by).agg(
        F.transform(order, lambda s: s["v"]).alias("_tail"), F.max(spec.ts).alias("_last")
    )
    state = materialize(state)
    short = state.filter(F.size("_tail") < deepest).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))))
    short = short.select(*spec.by, "h", add_steps(F.col("_last"), F.col("h"), freq).alias(spec.ts), F.lit(None).cast("double").alias("yhat"), F.lit("too_few_rows").alias("reason"))
    state = state.filter(F.size("_tail") >= deepest)
    if model.levels is not None:
        state = series_join(state, model.levels, spec.by)
    if model.exog:
        if exog is None:
            exog = carry_exog(history, future_dates(history, spec, horizon, freq), spec, model.exog)
        steps = exog.groupBy(*spec.by).agg(F.sort_array(F.collect_list(F.struct("h", *model.exog))).alias("_exog"))
        state = series_join(state, steps, spec.by)
    state = state.withColumn("_path", F.array().cast("array<struct<h:int,ts:timestamp_ntz,yhat:double>>"))
    state = materialize(state)
    kept = state.columns
    for h in range(1, horizon + 1):
        now = state.withColumn(spec.ts, add_steps(F.col("_last"), F.lit(h), freq))
        now = now.withColumns(_tail_columns(F.col("_tail"), model.lags, model.windows, model.span))
        now = tree_date_features(now, spec.ts)
        if model.exog:
            now = now.withColumns({c: F.try_element_at("_exog", F.lit(h))[c] for c in model.exog})
        now = model.apply(now)
        step = F.array(F.struct(F.lit(h).alias("h"), F.col(spec.ts).alias("ts"), F.col("pred").alias("yhat")))
        tail = F.concat(F.slice("_tail", -(reach - 1), reach - 1) if reach > 1 else F.array().cast("array<double>"), F.array("pred"))
        tail = F.when(F.size("_tail") < reach, F.concat("_tail", F.array("pred"))).otherwise(tail)
        state = now.withColumn("_path", F.concat("_path", step)).withColumn("_tail", tail).select(*kept)
        if h % _STEPS_PER_PLAN == 0 and h < horizon:
            state = materialize(state)
    path = state.select(*spec.by, F.explode("_path").alias("_p"))
    return path.select(*spec.by, "_p.h", F.col("_p.ts").alias(spec.ts), "_p.yhat", F.lit(None).cast("string").alias("reason")).unionByName(short)


