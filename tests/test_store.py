"""Stored models, and the forecast of the best model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SPEC, noise, series
from seriesloom.forecast import arima, baseline, decomposable, tree
from seriesloom.forecast.store import ModelStore
from seriesloom.functions.features import tree_features
from seriesloom.operators.splits import split_ratio
from seriesloom.plans.best import best_forecasts
from seriesloom.session import materialize


def values(df):
    return sorted((r["grp"], r["h"], r["yhat"]) for r in df.collect())


def test_models_come_back_the_same(spark, tmp_path):
    t = np.arange(160)
    df = materialize(series(spark, {"a": 10 + np.sin(t / 3) + 0.1 * noise(160), "b": 50 + t + noise(160, 3), "short": [1.0, 2.0]}))
    store, other = ModelStore(spark, str(tmp_path / "m")), ModelStore(spark.newSession(), str(tmp_path / "m"))
    assert store.versions("arima").count() == 0
    with pytest.raises(KeyError):
        store.load("arima")
    cfg = arima.ArimaConfig(auto=False, seasonal=False)
    fit = arima.fit_arima(df, SPEC, "D", cfg)
    assert store.save_table("arima", fit, note="first") == 1
    assert store.save_table("arima", fit.where("grp = 'a'"), note="second") == 2
    now = other.load("arima")
    assert (now.version, now.meta) == (2, {"note": "second"}) and now.model.count() == 1
    assert values(arima.predict_arima(other.load("arima", 1).model, SPEC, 4, "D", cfg)) == values(arima.predict_arima(fit, SPEC, 4, "D", cfg))
    with pytest.raises(KeyError):
        other.load("arima", 3)
    parts = decomposable.fit_decomposable(df, SPEC)
    store.save_table("parts", parts)
    grid = baseline.future_dates(df, SPEC, 3)
    assert values(decomposable.predict_decomposable(other.load("parts").model, other.spark.createDataFrame(grid.collect(), grid.schema), SPEC)) == values(decomposable.predict_decomposable(parts, grid, SPEC))
    table = materialize(split_ratio(tree_features(df, SPEC), SPEC))
    model = tree.train_random_forest(table, SPEC, numTrees=3)
    store.save_tree("forest", model, rows=320)
    back = store.load("forest")
    assert back.meta == {"rows": 320} and back.model.features == model.features and list(back.model.lags) == list(model.lags)
    mine, again = tree.fc_tree_recursive(model, df, SPEC, 3), tree.fc_tree_recursive(back.model, df, SPEC, 3)
    assert sorted(map(str, mine.collect())) == sorted(map(str, again.collect()))


def test_a_save_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    store = ModelStore(spark, str(tmp_path / "m"))
    fits = spark.createDataFrame([("a", 1.0)], "grp string, beta double")
    store.save_table("x", fits)
    monkeypatch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        store.save_table("x", fits.withColumn("beta", F.lit(2.0)))
    assert ModelStore(spark, store.path).load("x").model.first()["beta"] == 1.0


def test_each_series_gets_its_own_best_model(spark):
    week = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0, 4.0]
    df = series(spark, {"weekly": week * 12, "walk": list(noise(84, 3).cumsum()), "tiny": [4.0]})
    ranked = spark.createDataFrame([("weekly", "seasonal_naive", 1), ("weekly", "naive", 2), ("walk", "naive", 1), ("walk", "moving_average", 2)], "grp string, model string, rank int")
    got = {(r["grp"], r["h"]): r for r in best_forecasts(df, SPEC, 7, ranked=ranked).collect()}
    assert len(got) == 21
    assert [got["weekly", h]["yhat"] for h in range(1, 8)] == week and got["weekly", 1]["model"] == "seasonal_naive"
    assert [got["walk", h]["yhat"] for h in range(1, 8)] == pytest.approx([noise(84, 3).cumsum()[-1]] * 7)
    assert got["tiny", 7]["yhat"] == 4.0 and got["tiny", 7]["model"] == "naive"
    own = best_forecasts(df, SPEC, 7, models=("naive", "seasonal_naive"))
    assert own.where("grp = 'weekly'").first()["model"] == "seasonal_naive"
    assert best_forecasts(df.limit(0), SPEC, 7, ranked=ranked).count() == 0


def test_recursive_trees_carry_their_regressors(spark):
    x = np.where(np.arange(150) % 7 < 2, 10.0, 0.0)
    df = series(spark, {"a": 5 + x + 0.01 * noise(150)})
    df = df.join(df.select("id", F.when(F.col("id") % 7 < 2, 10.0).otherwise(0.0).alias("x")), "id")
    table = materialize(split_ratio(tree_features(df, SPEC, lags=(1,), windows=(2,), span=None), SPEC))
    model = tree.train_gbt(table, SPEC, "xgboost", delta=False, made={"lags": (1,), "windows": (2,), "span": None, "exog": ["x"]}, maxIter=10)
    assert "x" in model.features
    grid = baseline.future_dates(df, SPEC, 7)
    given = tree.fc_tree_recursive(model, df, SPEC, 7, exog=grid.withColumn("x", F.when((F.col("h") + 149) % 7 < 2, 10.0).otherwise(0.0)))
    assert values(tree.fc_tree_recursive(model, df, SPEC, 7)) == values(given)  # the same weekday of the last week
