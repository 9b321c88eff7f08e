"""NULL groups, NaN, suffixes, empty tables, nested sizes and state folders."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import catalog
import check
from seriesloom.operators.clean import absent_dates, fill_missing_dates
from seriesloom.operators.outliers import outlier_isolation_forest
from seriesloom.operators.series import head_tail
from seriesloom.operators.spectral import seasonality_decomp
from seriesloom.operators.profile import outlier_positions
from seriesloom.forecast.baseline import fc_intervals, last_rows
from seriesloom.session import materialize, written_bytes
from seriesloom.spec import SeriesSpec
from seriesloom.streaming.state import apply_batch, read_state
from tests.conftest import SF
from tests.helpers import SCHEMA, SPEC, T0

NAMES = ["null_group_fill_dates", "null_group_absent_dates", "null_group_reindex", "null_group_regressors", "null_group_pairs", "nan_standardize", "nan_minmax", "nan_rolling", "nan_ewm", "nan_rank", "suffix_coerce"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    assert check.rows(catalog.QUERIES[name](spark, SF).toPandas()) == check.rows(duck.execute(catalog.SQL[name]).df())


def day(k):
    import datetime as dt

    return T0 + dt.timedelta(days=k)


def test_null_group_is_a_series(spark):
    df = spark.createDataFrame([(g, day(k), 1.0, k) for g in (None, "a") for k in (0, 1, 3)], SCHEMA)
    assert fill_missing_dates(df, SPEC, "D").count() == 8 and absent_dates(df, SPEC, "D").count() == 2


def test_nan_history_has_bands(spark):
    df = spark.createDataFrame([("a", day(k), float("nan") if k == 2 else float(k), k) for k in range(6)], SCHEMA)
    fc = spark.createDataFrame([("a", 1, 5.0)], "grp string, h int, yhat double")
    r = fc_intervals(fc, df, SPEC).first()
    assert r.lo95 < 5 < r.hi95


def test_empty_decomposition(spark):
    assert seasonality_decomp(spark.createDataFrame([], SCHEMA), SPEC).count() == 0


def test_ties_have_one_order(spark):
    rows = [("a", day(0), float(k), k) for k in range(40)]
    spec = SeriesSpec(group="grp")
    few = last_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), spec, 7).collect()
    many = last_rows(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), spec, 2000).collect()
    assert [r.id for r in sorted(few, key=lambda r: r.pos)] == [r.id for r in sorted(many, key=lambda r: r.pos)][-7:]


def test_limits_are_under_the_shuffle(spark):
    df = spark.createDataFrame([("a", day(k), float(k % 9), k) for k in range(60)], SCHEMA)
    one = SeriesSpec(tie="id")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan(head_tail(df, one, 3)) and "WindowGroupLimit" in plan(head_tail(df, SPEC, 3))
    assert "TakeOrdered" in plan(outlier_positions(df, one))


def test_nested_strings_are_measured(spark):
    one = spark.range(1).select(F.struct(F.repeat(F.lit("x"), 100_000).alias("s")).alias("a"), F.array(F.repeat(F.lit("y"), 5000)).alias("b"), F.create_map(F.lit("k"), F.repeat(F.lit("z"), 7000)).alias("c"))
    assert written_bytes(materialize(one)) > 112_000


def test_old_epochs_go(spark, tmp_path):
    for e in range(5):
        apply_batch(spark.createDataFrame([("a", day(e), float(e), e)], SCHEMA), e, SPEC, 2, str(tmp_path / "s"))
    assert sorted(os.listdir(tmp_path / "s")) == ["epoch=3", "epoch=4"]
    assert sorted(r.y for r in read_state(spark, str(tmp_path / "s")).collect()) == [3.0, 4.0]


def test_forest_draws_from_all_rows(spark):
    df = spark.createDataFrame([("a", day(k), float(k % 10), k) for k in range(3000)] + [("a", day(3000 + k), 500.0 + 40 * k, 3000 + k) for k in range(12)], SCHEMA).repartition(4)
    out = outlier_isolation_forest(df, SPEC, contamination=0.01).toPandas()
    assert len(out) == 3012 and out[out.y >= 500].is_outlier.all()
