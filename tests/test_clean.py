import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SPEC, T0, by_group, noise, pandas_series, series, skewed
from seriesloom.functions import transforms
from seriesloom.operators import clean, outliers
from seriesloom.plans.preprocess import PreprocessConfig, preprocess
from seriesloom.spec import SeriesSpec


@pytest.mark.parametrize("partitions", [1, 6])
@pytest.mark.parametrize("method", ["forward_fill", "backward_fill", "interpolate"])
def test_ordered_fills(spark, method, partitions):
    got = by_group(clean.fill_ordered(series(spark, skewed()), SPEC, ["y"], method, partitions), "y")
    for g, s in pandas_series(skewed()).items():
        want = {"forward_fill": s.ffill, "backward_fill": s.bfill, "interpolate": s.interpolate}[method]()
        np.testing.assert_allclose(got[g][:, 0], want, atol=1e-9)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("a", T0, 1.0, 0), ("a", T0 + dt.timedelta(1), float("nan"), 1)], "grp string, ts timestamp_ntz, y double, id bigint")
    assert clean.missing_cells(df, ["y"]).first()["n_missing"] == 1
    assert by_group(clean.fill_forward(df, SPEC), "y")["a"][:, 0].tolist() == [1.0, 1.0]


@pytest.mark.parametrize("method", ["mean", "median"])
def test_statistic_fills(spark, method):
    got = by_group(clean.fill_missing(series(spark, skewed()), SPEC, method), "y")
    for g, s in pandas_series(skewed()).items():
        np.testing.assert_allclose(got[g][:, 0], s.fillna(getattr(s, method)()), atol=1e-9)


def test_short_spellings_and_unknown_methods(spark):
    df = series(spark, {"a": [1.0, None]})
    assert by_group(clean.fill_missing(df, SPEC, "ffill"), "y")["a"][:, 0].tolist() == [1.0, 1.0]
    with pytest.raises(ValueError):
        clean.fill_missing(df, SPEC, "guess")


@pytest.mark.parametrize("freq,step", [("D", 1), ("W", 7)])
def test_grid_and_gaps(spark, freq, step):
    days = [0, step, 4 * step, 4 * step, 9000 * step]
    df = spark.createDataFrame([("a", T0 + dt.timedelta(d), float(d), i) for i, d in enumerate(days)], "grp string, ts timestamp_ntz, y double, id bigint")
    grid = [r["ts"] for r in clean.date_grid(df, SPEC, freq).orderBy("ts").collect()]
    assert grid == [T0 + dt.timedelta(k * step) for k in range(9001)]
    gaps = clean.date_gaps(df, SPEC, freq).first()
    assert (gaps["n_rows"], gaps["n_unique"], gaps["n_duplicates"], gaps["missing_points"]) == (5, 4, 1, 9001 - 4)
    assert clean.missing_summary(df, SPEC, freq).first()["missing_dates"] == 9001 - 5
    assert clean.absent_dates(df, SPEC, freq).count() == 9001 - 4


def test_month_grid_counts_from_the_first_date(spark):
    df = spark.createDataFrame([("a", dt.datetime(2023, 1, 31), 1.0, 0), ("a", dt.datetime(2023, 4, 30), 2.0, 1)], "grp string, ts timestamp_ntz, y double, id bigint")
    grid = [r["ts"].date() for r in clean.date_grid(df, SPEC, "M").orderBy("ts").collect()]
    assert grid[:3] == [dt.date(2023, 1, 31), dt.date(2023, 2, 28), dt.date(2023, 3, 31)]


def test_reindex_takes_the_last_of_a_date(spark):
    rows = [("a", T0 + dt.timedelta(1), 1.0, 0), ("a", T0 + dt.timedelta(1), 2.0, 1), ("a", T0 + dt.timedelta(3), 5.0, 2)]
    df = spark.createDataFrame(rows, "grp string, ts timestamp_ntz, y double, id bigint")
    grid = spark.createDataFrame([("a", T0 + dt.timedelta(k)) for k in range(5)], "grp string, ts timestamp_ntz")
    got = by_group(clean.reindex_fill(df, grid, SPEC, ["y"]), "y")
    assert got["a"][:, 0].tolist() == [2.0, 2.0, 2.0, 5.0, 5.0]


def test_iqr_and_zscore_flags(spark):
    groups = {"a": [*noise(60, 1), 40.0, None], "const": [3.0] * 8}
    df = series(spark, groups)
    for method in ("iqr", "zscore"):
        got = by_group(outliers.flag_outliers(df, SPEC, method, 1.5).withColumn("f", F.col("is_outlier").cast("int")), "f")
        s = np.array([v for v in groups["a"] if v is not None], dtype=float)
        q1, q3 = np.quantile(s, [0.25, 0.75])
        want = (s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1)) if method == "iqr" else np.abs((s - s.mean()) / s.std()) > 1.5
        assert got["a"][:, 0].tolist() == [*want.astype(float), 0.0]
        assert not got["const"].any()


def test_outlier_actions(spark):
    groups = {"a": [*noise(60, 1), 40.0]}
    s = np.array(groups["a"])
    q1, q3 = np.quantile(s, [0.25, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    df = series(spark, groups)
    np.testing.assert_allclose(by_group(outliers.outlier_clip(df, SPEC), "y")["a"][:, 0], np.clip(s, lo, hi))
    assert outliers.outlier_remove(df, SPEC).count() == ((s >= lo) & (s <= hi)).sum()
    assert outliers.outlier_clip(df, SPEC, "zscore").count() == len(s)
    p5, p95 = np.quantile(s, [0.05, 0.95])
    bad = (s < lo) | (s > hi)
    np.testing.assert_allclose(by_group(outliers.outlier_winsorize(df, SPEC), "y")["a"][:, 0], np.where(bad, np.clip(s, p5, p95), s))
    np.testing.assert_allclose(by_group(outliers.outlier_median(df, SPEC), "y")["a"][:, 0], np.where(bad, np.median(s), s))


def test_isolation_forest_finds_the_far_values(spark, monkeypatch):
    monkeypatch.setattr(outliers, "_ROWS_PER_TASK", 64)
    values = list(noise(400, 2)) + [25.0, -30.0]
    df = series(spark, {"a": [*values, None], "b": [1.0] * 30})
    out = outliers.outlier_isolation_forest(df, SPEC).toPandas()
    assert len(out) == len(values) + 1 + 30
    a = out[(out["grp"] == "a") & out["y"].notna()]
    assert a[a["y"].abs() > 20]["is_outlier"].all()
    assert 0.05 < a["is_outlier"].mean() <= 0.11
    assert not out[out["grp"] == "b"]["is_outlier"].any()
    same = a.groupby("y")["score"].nunique()
    assert (same == 1).all()


def test_yeo_johnson_lambda_is_the_likeliest(spark):
    x = np.exp(noise(300, 4)) - 0.5
    lam = transforms.yeo_johnson_lambda(series(spark, {"a": x}), SPEC).first()["lambda"]

    def ll(v):
        up = np.log1p(x) if abs(v) < 1e-9 else ((np.maximum(x, 0) + 1) ** v - 1) / v
        down = -np.log1p(-np.minimum(x, 0)) if abs(v - 2) < 1e-9 else -((1 - np.minimum(x, 0)) ** (2 - v) - 1) / (2 - v)
        z = np.where(x >= 0, up, down)
        return -len(x) / 2 * np.log(z.var()) + (v - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    grid = np.linspace(-3, 3, 6001)
    assert lam == pytest.approx(grid[np.argmax([ll(v) for v in grid])], abs=2e-3)
    z = by_group(transforms.tx_yeo_johnson(series(spark, {"a": x}), SPEC), "y")["a"][:, 0]
    assert abs(z.mean()) < 1e-9 and abs(z.std() - 1) < 1e-9


def test_scalers_on_a_constant_series(spark):
    df = series(spark, {"c": [4.0] * 5})
    for method in ("standardize", "normalize"):
        assert not by_group(transforms.transform(df, SPEC, method), "y")["c"].any()
    with pytest.raises(ValueError):
        transforms.transform(df, SPEC, "cube")


def test_preprocess_counts(spark):
    df = series(spark, {"a": [1.0, None, 3.0, 100.0, 4.0, 5.0, 2.0, 3.0]})
    out, report = preprocess(df, SPEC, PreprocessConfig(missing="bfill", outliers="iqr", lags=(1,), diff_order=1))
    r = report.first()
    assert (r["original_rows"], r["missing_handled"], r["outliers_handled"], r["features_created"]) == (8, 1, 1, "y_lag_1")
    assert r["processed_rows"] == out.count() == 5 and r["removed_rows"] == 3


def test_preprocess_without_any_step(spark):
    df = series(spark, {"a": [1.0, None]})
    out, report = preprocess(df, SeriesSpec(group="grp", tie="id"), PreprocessConfig())
    assert out.count() == 2 and report.first()["missing_handled"] == 0
