import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SPEC, T0, by_group, noise, series
from seriesloom.forecast import arima, baseline, decomposable, tree
from seriesloom.functions.features import tree_features
from seriesloom.operators import exog, metrics, ranking, splits
from seriesloom.operators.series import row_positions
from seriesloom.plans.backtest import backtest_baselines
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec


def paths(df, column="yhat"):
    pdf = df.toPandas().sort_values(["grp", "h"])
    return {g: p[column].tolist() for g, p in pdf.groupby("grp")}


def test_baselines(spark):
    df = series(spark, {"a": range(10), "short": [5.0, 6.0], "none": [None, None]})
    assert paths(baseline.fc_naive(df, SPEC, 3))["a"] == [9.0] * 3
    tiled = paths(baseline.fc_seasonal_naive(df, SPEC, 5, period=4))
    assert tiled["a"] == [6.0, 7.0, 8.0, 9.0, 6.0] and tiled["short"] == [5.0, 6.0, 5.0, 6.0, 5.0]
    assert paths(baseline.fc_moving_average(df, SPEC, 2, window=4))["a"] == [7.5, 7.5]
    assert baseline.future_dates(df, SPEC, 2, "M").filter("grp = 'a' AND h = 2").first()["ts"] == dt.datetime(2023, 3, 10)


def test_long_seasonal_state_goes_through_the_index(spark):
    df = series(spark, {"a": range(1300)})
    state = baseline.last_rows(df, SPEC, 1100).toPandas()
    assert len(state) == 1100 and state.sort_values("pos")["y"].iloc[0] == 200.0


def test_state_update_equals_full_history(spark):
    df = series(spark, {"a": range(30), "b": range(5)})
    cut = T0 + dt.timedelta(20)
    old = baseline.seasonal_state(df.filter(F.col("ts") < cut), SPEC, 7)
    new = baseline.state_update(old, df.filter(F.col("ts") >= cut), SPEC, 7)
    assert by_group(new, "y", "pos")["a"].tolist() == by_group(baseline.seasonal_state(df, SPEC, 7), "y", "pos")["a"].tolist()


def test_ungrouped_baselines(spark):
    df, spec = series(spark, {"a": range(10)}).drop("grp"), SeriesSpec(tie="id")
    out = baseline.fc_intervals(baseline.fc_seasonal_naive(df, spec, 3, period=2), df, spec).orderBy("h").collect()
    assert [r["yhat"] for r in out] == [8.0, 9.0, 8.0]
    assert out[0]["hi95"] - out[0]["yhat"] == pytest.approx(1.96 * np.std(range(10), ddof=1))


def test_interval_levels_nest(spark):
    df = series(spark, {"a": noise(50)})
    rows = baseline.fc_intervals_multi(baseline.fc_naive(df, SPEC, 1), df, SPEC).orderBy("level").collect()
    assert rows[1]["lo"] < rows[0]["lo"] < rows[0]["yhat"] < rows[0]["hi"] < rows[1]["hi"]


def test_split_edges(spark):
    df = series(spark, {"a": range(10), "one": [1.0], "late": range(3)})
    got = splits.split_ratio(df, SPEC).groupBy("grp", "split").count().toPandas().set_index(["grp", "split"])["count"].to_dict()
    assert got == {("a", "train"): 7, ("a", "val"): 1, ("a", "test"): 2, ("one", "test"): 1, ("late", "train"): 2, ("late", "test"): 1}
    cut = splits.split_cutoff(df, SPEC, "2022-12-31").groupBy("grp", "split").count().toPandas().set_index(["grp", "split"])["count"].to_dict()
    assert cut == got
    cv = splits.split_cv(series(spark, {"a": range(12)}), SPEC, 3).toPandas()
    assert cv[cv.split == "test"].groupby("fold").size().tolist() == [3, 3, 3]
    assert cv[cv.split == "train"].groupby("fold").size().tolist() == [3, 6, 9]
    assert splits.split_checks(df, SPEC, horizon=1).count() == 2


def pairs(spark, rows):
    return spark.createDataFrame([("m", g, float(a), float(p)) for g, a, p in rows], "model string, grp string, actual double, pred double")


def test_metric_edges(spark):
    df = pairs(spark, [("zero", 0, 0), ("zero", 0, 1), ("const", 2, 2), ("const", 2, 2), ("off", 2, 3), ("off", 2, 3), ("one", 1, 2)])
    train = series(spark, {"zero": [1.0, 3.0], "const": [1.0, 1.0], "off": [1.0]})
    got = {r["grp"]: r for r in metrics.score(df, train, SPEC, ["grp", "model"]).collect()}
    assert got["zero"]["mape"] == 0.0 and got["zero"]["smape"] == 200.0 and got["zero"]["mase"] == 0.25
    assert got["const"]["r2"] == 1.0 and got["off"]["r2"] == 0.0 and got["one"]["r2"] is None
    assert got["const"]["mase"] == 0.0 and got["off"]["mase"] == 0.0 and got["one"]["mase"] == 0.0
    diag = {r["grp"]: r for r in metrics.fit_diagnostics(df, ["grp"]).collect()}
    assert (diag["const"]["correlation"], diag["const"]["std_ratio"]) == (0.0, 1.0)


def test_ranking_of_ties_and_missing_metrics(spark):
    df = spark.createDataFrame([("b", 1.0, 0.2), ("a", 1.0, None), ("c", None, 0.9)], "model string, rmse double, r2 double")
    assert [r["model"] for r in ranking.rank_models(df, "rmse").orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r["model"] for r in ranking.rank_models(df, "r2").orderBy("rank").collect()] == ["c", "b", "a"]


def test_backtest_ranks_the_seasonal_model_first(spark):
    df = series(spark, {"a": np.tile(np.arange(7.0), 20), "b": np.full(60, 3.0)})
    got = backtest_baselines(df, SPEC).toPandas()
    best = got[(got.grp == "a") & (got["rank"] == 1)].iloc[0]
    assert best.model == "seasonal_naive" and best.rmse == 0.0
    assert set(got[got.grp == "b"].mae) == {0.0}


def test_recursive_features_equal_window_features(spark):
    y = 20 + noise(80, 5)
    df = series(spark, {"a": y})
    one_more = series(spark, {"a": [*y, 0.0]})
    want = tree_features(one_more, SPEC).orderBy(F.desc("ts")).first()
    tail = spark.createDataFrame([(y.tolist(),)], "_t array<double>")
    cols = tree._tail_columns(F.col("_t"), (1, 7, 14, 28), (7, 14, 30), 7)
    got = tail.select(*[c.alias(n) for n, c in cols.items()]).first()
    for n in cols:
        assert got[n] == pytest.approx(want[n], rel=1e-9), n
    assert df.count() == 80


def test_trees(spark):
    t = np.arange(150)
    groups = {g: 50 + 10 * k + 5 * np.sin(2 * np.pi * t / 7) + 0.2 * noise(150, k) for k, g in enumerate("ab")}
    df = series(spark, {**groups, "short": range(5)})
    rows = materialize(row_positions(df, SPEC))
    table = materialize(splits.split_ratio(tree_features(rows, SPEC), SPEC))
    model = tree.train_gbt(table, SPEC, "lightgbm", maxIter=15, maxDepth=4, stepSize=0.2)
    assert "_idx" not in model.features and model.delta
    test = tree.backtest_tree(model, table, SPEC).filter("grp <> 'short'").toPandas()
    err = np.sqrt(((test.actual - test.pred) ** 2).mean())
    assert err < 0.5 * test.groupby("grp")["actual"].std().mean()
    fc = paths(tree.fc_tree_recursive(model, df, SPEC, 8))
    assert set(fc) == {"a", "b", "short"} and all(len(v) == 8 for v in fc.values()) and np.isnan(np.array(fc["short"], dtype=float)).all()
    assert np.abs(np.array(fc["b"]) - (60 + 5 * np.sin(2 * np.pi * np.arange(150, 158) / 7))).mean() < 3
    imp = tree.feature_importance(model, spark).toPandas()
    assert imp.importance.is_monotonic_decreasing and imp.importance.sum() == pytest.approx(1.0)


def test_random_forest_without_differences(spark):
    rows = row_positions(series(spark, {"a": 5 + np.sin(np.arange(120.0))}), SPEC)
    table = materialize(splits.split_ratio(tree_features(rows, SPEC), SPEC))
    model = tree.train_random_forest(table, SPEC, delta=False, numTrees=8, maxDepth=4)
    out = tree.backtest_tree(model, table, SPEC).toPandas()
    assert not model.delta and ((out.actual - out.pred) ** 2).mean() < 0.2


def test_decomposable_recovers_a_known_shape(spark):
    t = np.arange(400)
    season = 1 + 0.2 * np.sin(2 * np.pi * t / 7)
    df = series(spark, {"up": (100 + 0.5 * t) * season, "neg": -50 + 0.1 * t + 3 * np.sin(2 * np.pi * t / 7)})
    out = decomposable.fc_decomposable(df, SPEC, baseline.future_dates(df, SPEC, 14))
    got = paths(out)
    f = np.arange(400, 414)
    np.testing.assert_allclose(got["up"], (100 + 0.5 * f) * (1 + 0.2 * np.sin(2 * np.pi * f / 7)), rtol=0.03)
    np.testing.assert_allclose(got["neg"], -50 + 0.1 * f + 3 * np.sin(2 * np.pi * f / 7), atol=1.0)
    assert out.filter("NOT (lo <= yhat AND yhat <= hi)").count() == 0


def test_decomposable_uses_regressors(spark):
    x = noise(200, 8)
    df = series(spark, {"a": 10 + 3 * x}).join(spark.createDataFrame([(T0 + dt.timedelta(i), float(v)) for i, v in enumerate(x)], "ts timestamp_ntz, x double"), "ts")
    cfg = decomposable.DecomposableConfig(regressors=("x",), multiplicative=False, changepoints=3)
    grid = baseline.future_dates(df, SPEC, 2).withColumn("x", F.when(F.col("h") == 1, 0.0).otherwise(2.0))
    got = paths(decomposable.fc_decomposable(df, SPEC, grid, cfg))["a"]
    assert got[1] - got[0] == pytest.approx(6.0, abs=0.5)


def test_arima_follows_an_autoregression(spark):
    x = 10 + noise(600, 11, 0.8)
    df = series(spark, {"a": x, "short": [1.0, 2.0, 3.0]})
    cfg = arima.ArimaConfig(auto=False, seasonal=False, p=1, d=0, q=0)
    out = arima.fc_arima(df, SPEC, 5, "D", cfg)
    got = paths(out)
    want = 10 + (x[-1] - 10) * 0.8 ** np.arange(1, 6)
    np.testing.assert_allclose(got["a"], want, atol=0.6)
    assert got["short"] == [3.0] * 5
    width = out.filter("grp = 'a'").orderBy("h").select((F.col("hi") - F.col("lo")).alias("w")).toPandas()["w"]
    assert width.is_monotonic_increasing and width[0] == pytest.approx(2 * 1.96, rel=0.15)


def test_arima_differences_and_search(spark):
    t = np.arange(300)
    df = series(spark, {"line": 5 + 2.0 * t + 0.1 * noise(300), "weekly": 10 + 4 * np.sin(2 * np.pi * t / 7) + 0.1 * noise(300, 2)})
    got = paths(arima.fc_arima(df, SPEC, 7, "D"))
    f = np.arange(300, 307)
    np.testing.assert_allclose(got["line"], 5 + 2.0 * f, atol=2.0)
    np.testing.assert_allclose(got["weekly"], 10 + 4 * np.sin(2 * np.pi * f / 7), atol=1.0)


def test_integration_of_differences():
    path = arima._project(list(range(10)), [1.0] * 10, [0.0] * 10, 1, 0, 1, [1.0], [], [], 0.25, 3, 1.96)
    assert [p[1] for p in path] == [10.0, 11.0, 12.0]
    assert [round(p[3] - p[1], 6) for p in path] == [round(1.96 * 0.5 * k**0.5, 6) for k in (1, 2, 3)]


def test_carried_regressors(spark):
    rows = [("a", T0 + dt.timedelta(k), float(k), k) for k in range(400)] + [("b", T0 + dt.timedelta(k), float(k), 1000 + k) for k in range(20)]
    hist = spark.createDataFrame(rows, "grp string, ts timestamp_ntz, x double, id bigint")
    grid = baseline.future_dates(hist, SPEC, 3)
    got = paths(exog.carry_exog(hist, grid, SPEC, ["x"]), "x")
    assert got["a"] == [35.0, 36.0, 37.0]
    assert got["b"] == [13.0, 14.0, 15.0]
    assert paths(exog.last_value_exog(hist, grid, SPEC, ["x", "z"]), "x")["a"] == [399.0] * 3


def test_regressor_lookup_falls_back(spark):
    grid = series(spark, {"a": range(4), "b": range(2)}).select("grp", "ts")
    regs = spark.createDataFrame([("a", T0 + dt.timedelta(1), 7.0)], "grp string, ts timestamp_ntz, x double")
    got = by_group(exog.regressor_lookup(grid, regs, SPEC, ["x"]), "x")
    assert got["a"][:, 0].tolist() == [7.0] * 4 and got["b"][:, 0].tolist() == [0.0, 0.0]
