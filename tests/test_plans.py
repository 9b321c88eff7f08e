"""What the plans of registered queries look like, and their results against DuckDB."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import catalog
from catalog.base import PANEL, RAW_PANEL, panel, raw_events, table
from conftest import SF
from helpers import SPEC, series
from seriesloom.forecast.baseline import last_rows
from seriesloom.functions.features import date_features, rolling_features
from seriesloom.operators import joins
from seriesloom.operators.profile import first_outliers
from seriesloom.operators.series import build_series, date_scope
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


FAST = [
    "build_series", "date_scope", "group_candidates", "head_tail", "dedupe_keep_last", "carry_exog", "missing_summary", "fill_interpolate", "outlier_winsorize",
    "tx_box_cox", "lag_features", "rolling_features", "ewm_feature", "fourier_year", "split_cutoff", "split_cv", "split_checks", "describe_target", "histogram30",
    "boxplot_overall", "acf", "seasonal_decompose_even", "fc_seasonal_naive", "fc_intervals_multi", "metric_mase", "eval_advice", "export_with_history", "model_scoring",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cells(pdf):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return ""
        return v.isoformat() if hasattr(v, "isoformat") else repr(v)

    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(plain, r)) for r in pdf[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", FAST)
def test_query_against_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert cells(got) == cells(want)


def test_every_query_is_named_once_and_sql_belongs_to_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 100


def test_scans_are_pruned_and_filtered(spark):
    text = plan(date_scope(table(spark, SF, "lineitem").select("l_orderkey", "l_shipdate"), SeriesSpec(ts="l_shipdate"), "1997-01-01"))
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>", text)
    text = plan(build_series(table(spark, SF, "orders"), "o_orderdate", "o_totalprice", "D", ["o_orderpriority"]))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text
    assert text.count("Exchange") == 1


def test_no_python_and_no_cross_join_in_column_operators(spark):
    for df in (
        rolling_features(raw_events(spark, SF), RAW_PANEL),
        catalog.QUERIES["outlier_iqr"](spark, SF), catalog.QUERIES["describe_target"](spark, SF), catalog.QUERIES["seasonal_decompose"](spark, SF),
        catalog.QUERIES["fill_forward"](spark, SF), catalog.QUERIES["carry_exog"](spark, SF), date_features(panel(spark, SF), "ts"),
    ):
        text = plan(df)
        for bad in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text, bad


def test_windows_run_per_block(spark):
    text = plan(rolling_features(raw_events(spark, SF), RAW_PANEL))
    windows = [line for line in text.splitlines() if re.search(r"\bWindow \[", line)]
    assert windows and all("_blk" in w for w in windows)


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(last_rows(panel(spark, SF), PANEL, 7))
    assert "WindowGroupLimit" in plan(first_outliers(raw_events(spark, SF), RAW_PANEL, 50))


def test_large_right_sides_are_not_broadcast(spark):
    big, small = series(spark, {"a": range(50), "b": range(5)}), spark.createDataFrame([("a", 1), ("b", 2)], "grp string, k int")
    assert "BroadcastHashJoin" in plan(joins.keyed_join(big, small, ["grp"]))
    shuffled = joins.keyed_join(big, small, ["grp"], limit=0)
    text = shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in text
    assert shuffled.agg(F.sum("k")).first()[0] == 60


def test_written_statistics_are_not_written_again(spark):
    stats = materialize(spark.createDataFrame([("a", 1)], "grp string, k int"))
    out = joins.attach(series(spark, {"a": range(3), "b": [1.0]}), stats, ["grp"])
    assert sorted((r["grp"], r["k"]) for r in out.collect()) == [("a", 1)] * 3 + [("b", None)]
    assert SPEC.by == ["grp"]


def test_eval_summary_sums_the_training_time(spark, tmp_path):
    days, hours = {"1-URGENT": 40, "5-LOW": 23}, {"click": 31}
    orders = [(f"{i:03}", g, 100.0 + i % 9 + len(g)) for g, n in days.items() for i in range(n)]
    spark.createDataFrame(orders, "d string, o_orderpriority string, o_totalprice double").selectExpr("date_add(date'2024-01-01', int(d)) o_orderdate", "*").write.parquet(str(tmp_path / "orders.parquet"))
    events = [(i, g, float(i % 5)) for g, n in hours.items() for i in range(n)]
    spark.createDataFrame(events, "h int, event_type string, value double").selectExpr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, h) ts", "*").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["eval_summary"](spark, str(tmp_path)).first()
    test_rows = sum(n - math.floor(n * 0.7) - math.floor(n * 0.15) for n in (days | hours).values())
    assert got["total_training_time"] == test_rows * (len("naive") + len("seasonal_naive")) and got["timed"]
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(catalog.SQL["eval_summary"]).df()
    assert {c: got[c] for c in got.asDict()} == pytest.approx(want.iloc[0].to_dict()) and got["total_models"] == 6
