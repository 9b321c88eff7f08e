"""Early stopping with patience, and series too short for a recursive forecast."""

import datetime as dt
import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from seriesloom.forecast import tree
from seriesloom.functions.features import tree_features
from seriesloom.operators.series import row_positions
from seriesloom.operators.splits import split_ratio
from tests.helpers import SCHEMA, SPEC, T0


def wave(spark):
    rng = np.random.default_rng(2)
    rows = [("a", T0 + dt.timedelta(days=k), 50 + 20 * math.sin(k / 3) + 5 * (k % 7) + float(rng.normal()), k) for k in range(260)]
    return spark.createDataFrame(rows + [("b", T0 + dt.timedelta(days=k), float(k), 1000 + k) for k in range(5)], SCHEMA)


def test_stops_at_the_best_round(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), float(np.sin(4 * x) + 0.3 * rng.normal()), k % 4 == 0) for k, x in enumerate(rng.uniform(0, 3, 240))]
    df = VectorAssembler(inputCols=["x"], outputCol="_x").transform(spark.createDataFrame(rows, "x double, _label double, v boolean")).coalesce(1).cache()
    train, val = df.filter("NOT v"), df.filter("v")
    settings = {"maxDepth": 3, "stepSize": 0.3, "maxIter": 60, "seed": 1, "featuresCol": "_x", "labelCol": "_label"}
    errors = GBTRegressor(**settings).fit(train).evaluateEachIteration(val, "squared")
    best, k = 0, 0
    while k < len(errors) and k - best < 5:  # the plain loop: wait five rounds for a better one
        best = k if errors[k] < errors[best] else best
        k += 1
    model = tree.boost_with_patience(settings, train, val, patience=5)
    assert model.getNumTrees == best + 1 > 1
    assert abs(model.evaluateEachIteration(val, "squared")[-1] - errors[best]) < 1e-9


def test_model_learns_and_short_series_say_why(spark):
    df = wave(spark)
    table = split_ratio(tree_features(row_positions(df, SPEC), SPEC), SPEC)
    model = tree.train_gbt(table, SPEC, maxDepth=4, stepSize=0.2, maxIter=60)
    assert model.model.getNumTrees > 1
    out = tree.fc_tree_recursive(model, df, SPEC, 4).toPandas()
    assert (out[out.grp == "b"].reason == "too_few_rows").all() and out[out.grp == "b"].yhat.isna().all() and len(out) == 8
    assert out[out.grp == "a"].yhat.notna().all() and out[out.grp == "a"].reason.isna().all()
