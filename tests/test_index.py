import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SPEC, by_group, pandas_series, series, skewed
from seriesloom.functions import features
from seriesloom.operators import index
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.operators.series import head_tail, modal_step, row_positions
from seriesloom.spec import SeriesSpec


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_are_dense_and_in_order(spark, partitions):
    df = series(spark, skewed())
    got = index.order_series(df, SPEC, partitions=partitions).indexed().toPandas().sort_values(["grp", "ts", "id"])
    for g, p in got.groupby("grp"):
        assert p["_idx"].tolist() == list(range(len(p)))
        assert set(p["_len"]) == {len(skewed()[g])}


def test_hot_series_is_spread_over_segments(spark):
    df = series(spark, {"hot": range(3000), "cold": range(10)})
    segs = index.order_series(df, SPEC, partitions=8).segs.filter("grp = 'hot'")
    assert segs.count() >= 6
    assert segs.agg(F.max("_n")).first()[0] < 1500


def test_equal_rows_without_tie_keep_a_place_each(spark):
    df = spark.createDataFrame([("a", 1.0)] * 20, "grp string, y double").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = row_positions(df, SeriesSpec(group="grp")).toPandas()
    assert sorted(got["_idx"]) == list(range(20))


def test_ungrouped_series(spark):
    df = series(spark, {"a": range(50)})
    got = index.order_series(df, SeriesSpec(tie="id"), partitions=5).indexed().toPandas().sort_values("ts")
    assert got["_idx"].tolist() == list(range(50))


def test_null_group_is_a_series(spark):
    df = series(spark, {"a": range(5)}).unionByName(series(spark, {"b": range(4)}).withColumn("grp", F.lit(None).cast("string")))
    got = row_positions(df, SPEC).toPandas()
    assert sorted(got[got["grp"].isna()]["_idx"]) == [0, 1, 2, 3]


@pytest.mark.parametrize("block", [None, 5, 16])
def test_windows_do_not_depend_on_blocks(spark, block, monkeypatch):
    if block:
        monkeypatch.setattr(index, "BLOCK_ROWS", block)
    df = series(spark, skewed())
    lag = by_group(features.lag_features(df, SPEC, [1, 3]), "y_lag_1", "y_lag_3")
    roll = by_group(features.rolling_features(df, SPEC, [4]), "y_rolling_mean_4", "y_rolling_std_4")
    past = by_group(features.tree_rolling_features(df, SPEC, [4]), "rolling_mean_4", "rolling_std_4")
    diff = by_group(features.diff_regular(df, SPEC, 2, iterated=True), "y_diff_1", "y_diff_2")
    for g, s in pandas_series(skewed()).items():
        np.testing.assert_allclose(lag[g], np.c_[s.shift(1), s.shift(3)])
        np.testing.assert_allclose(roll[g], np.c_[s.rolling(4).mean(), s.rolling(4).std()], atol=1e-9)
        np.testing.assert_allclose(past[g], np.c_[s.shift(1).rolling(4).mean(), s.shift(1).rolling(4).std()], atol=1e-9)
        np.testing.assert_allclose(diff[g], np.c_[s.diff(), s.diff().diff()], atol=1e-9)


@pytest.mark.parametrize("span", [3, 7])
def test_ewm_matches_adjusted_weights(spark, span):
    groups = dict(skewed(), long=list(np.sin(np.arange(700)) * 5))
    got = by_group(features.ewm_feature(series(spark, groups), SPEC, span), f"ewm_{span}")
    for g, s in pandas_series(groups).items():
        want = s.shift(1).ewm(span=span).mean()
        np.testing.assert_allclose(got[g][:, 0], want, rtol=1e-9, atol=1e-12)


def test_one_ordering_serves_many_features(spark):
    df = series(spark, skewed())
    once = row_positions(df, SPEC)
    both = features.diff_seasonal(features.lag_features(once, SPEC, [2]), SPEC, 3)
    got = by_group(both, "y_lag_2", "y_seasonal_diff")
    for g, s in pandas_series(skewed()).items():
        np.testing.assert_allclose(got[g], np.c_[s.shift(2), s.diff(3)], atol=1e-9)


@pytest.mark.parametrize("partitions", [1, 6])
def test_quantiles_with_a_hot_value(spark, partitions):
    rng = np.random.default_rng(5)
    values = np.r_[np.zeros(400), rng.normal(size=300), [np.nan] * 5]
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 2.0)], "grp string, y double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    got = {r["grp"]: [r[f"q{i}"] for i in range(len(probs))] for r in exact_quantiles(df, "y", probs, ["grp"], partitions=partitions).collect()}
    np.testing.assert_allclose(got["a"], np.nanquantile(values, probs), atol=1e-12)
    assert got["b"] == [2.0] * len(probs)
    whole = exact_quantiles(df, "y", [0.5], partitions=partitions).first()[0]
    assert whole == pytest.approx(np.nanquantile(np.r_[values, 2.0], 0.5))


def test_quantiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "grp string, y double")
    assert exact_quantiles(df, "y", [0.5], ["grp"]).count() == 0


def test_head_tail_and_modal_step(spark):
    df = series(spark, skewed())
    parts = head_tail(df, SPEC, 2).groupBy("grp", "part").count().toPandas().set_index(["grp", "part"])["count"]
    assert parts["big", "head"] == 2 and parts["one", "tail"] == 1
    steps = {r["grp"]: r["step_seconds"] for r in modal_step(df, SPEC).collect()}
    assert steps["big"] == 86400 and "one" not in steps
