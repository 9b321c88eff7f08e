import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import SPEC, T0, by_group, series
from seriesloom.forecast.baseline import fc_intervals, fc_model_select, fc_naive, fc_seasonal_naive, seasonal_state
from seriesloom.functions.features import holiday_flag
from seriesloom.operators.series import date_scope, dedupe_keep_last, union_parts
from seriesloom.operators.splits import split_ratio
from seriesloom.session import ensure_checkpoint_dir, materialize, written_bytes
from seriesloom.sources import sinks, tables
from seriesloom.spec import SeriesSpec
from seriesloom.streaming.state import read_state, start_state_stream


def test_csv_round_trip(spark, tmp_path):
    df = series(spark, {"a": [1.5, None, 3.0]}).withColumn("note", F.lit("x;y"))
    path = str(tmp_path / "t.csv")
    df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd")).write.option("header", True).option("sep", ";").csv(path)
    back = tables.load_table(spark, path, sep=";")
    back = tables.date_parse(tables.numeric_coerce(back, target="y"), "ts")
    assert dict(back.dtypes) == {"grp": "string", "ts": "timestamp_ntz", "y": "double", "id": "double", "note": "string"}
    assert sorted(r["y"] for r in back.collect() if r["y"] is not None) == [1.5, 3.0]
    with pytest.raises(ValueError):
        tables.load_table(spark, "x.xlsx")


def test_encoding(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name,v\nZürich,1\n".encode("latin-1"))
    assert tables.load_table(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").first()["name"] == "Zürich"


def test_coercion_is_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "2", "x"), (None, "b", "3")], "a string, b string, t string")
    out = tables.numeric_coerce(df, target="t")
    assert dict(out.dtypes) == {"a": "double", "b": "string", "t": "double"}
    assert [r["t"] for r in out.collect()] == [None, 3.0]


def test_dates_strict_and_lenient(spark):
    df = spark.createDataFrame([("2024-01-02",), ("never",)], "d string")
    assert sorted(str(r["d"]) for r in tables.date_parse(df, "d", strict=False).collect()) == ["2024-01-02 00:00:00", "None"]
    other = spark.createDataFrame([("02/01/2024",)], "d string")
    assert tables.date_parse(other, "d", "dd/MM/yyyy").first()["d"] == dt.datetime(2024, 1, 2)
    with pytest.raises(PySparkException):
        tables.date_parse(df, "d").collect()


def test_preview_cleans_numbers(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0)], "id int, v double")
    assert [r["v"] for r in tables.table_preview(df, ["id"], 3).collect()] == [None, None, 1.0]


def test_group_candidates(spark):
    df = spark.createDataFrame([(f"k{i}", "a" if i % 2 else "b", "d", "same") for i in range(60)], "id string, kind string, date_text string, one string")
    got = {r["column"]: (r["n_unique"], r["is_candidate"]) for r in tables.group_candidates(df).collect()}
    assert got == {"id": (60, False), "kind": (2, True), "one": (1, True)}
    assert {r["column"]: r["is_candidate"] for r in tables.group_candidates(df, approximate=True).collect()}["kind"]


def test_exports(spark):
    df = series(spark, {"a": range(9), "b": range(3)})
    fc = fc_intervals(fc_naive(df, SPEC, 3), df, SPEC).withColumn("model", F.lit("naive"))
    docs = sinks.forecast_documents(fc, ["grp"])
    long = sinks.export_long(docs, ["grp"], best="naive")
    assert long.count() == 6 and set(long.columns) == {"model", "grp", "date", "forecast", "lo95", "hi95"}
    both = sinks.export_with_history(long, df, "ts", "y", ["grp"])
    assert both.filter("model = 'historical' AND forecast IS NULL AND actual IS NOT NULL").count() == 12
    text = json.loads(sinks.export_json(fc, ["grp"]).filter("grp = 'a'").first()["document"])
    assert text["values"] == [8.0] * 3 and len(text["dates"]) == 3
    assert sinks.select_models(fc, ["other"]).count() == 6
    assert sinks.select_models(fc.withColumn("model", F.lit("naive (grp=a)")), ["naive"]).count() == 6


def test_model_choice(spark):
    df = series(spark, {"a": range(9), "b": range(9)})
    fc = fc_naive(df, SPEC, 2).withColumn("model", F.lit("n")).unionByName(fc_seasonal_naive(df, SPEC, 2).withColumn("model", F.lit("s")))
    ranked = spark.createDataFrame([("a", "n", 1), ("a", "s", 2), ("b", "s", 1), ("b", "n", 2)], "grp string, model string, rank int")
    best = fc_model_select(fc, "best", ranked, ["grp"]).select("grp", "model").distinct().collect()
    assert sorted(tuple(r) for r in best) == [("a", "n"), ("b", "s")]
    mean = fc_model_select(fc, "ensemble", by=["grp"]).filter("grp = 'a'").orderBy("ts").first()
    assert mean["yhat"] == (8.0 + 2.0) / 2
    with pytest.raises(ValueError):
        fc_model_select(fc, "best")


def test_written_splits_and_results(spark, tmp_path):
    rows = split_ratio(series(spark, {"a": range(20), "b": range(10)}), SPEC)
    sinks.write_splits(rows, str(tmp_path / "s"), ["grp"])
    part = spark.read.parquet(str(tmp_path / "s")).filter("grp = 'a' AND split = 'train'")
    assert part.count() == 14
    assert "PartitionFilters: [isnotnull(grp" in part._jdf.queryExecution().toString()
    for run in ("x", "y"):
        sinks.results_append(rows.groupBy("split").count(), str(tmp_path / "r"), run)
    assert spark.read.parquet(str(tmp_path / "r")).select("run_id").distinct().count() == 2


def test_dedupe_scope_union_holidays(spark):
    df = series(spark, {"a": range(5)})
    twice = df.unionByName(df.withColumns({"id": F.col("id") + 100, "y": F.col("y") + 0.5}))
    assert by_group(dedupe_keep_last(twice, SPEC), "y")["a"][:, 0].tolist() == [0.5, 1.5, 2.5, 3.5, 4.5]
    assert date_scope(df, SPEC, "2023-01-02", "2023-01-04").count() == 3
    assert union_parts(df, df.drop("y"), df).filter("y IS NULL").count() == 5
    days = spark.createDataFrame([(T0 + dt.timedelta(1, 3600),)], "ts timestamp_ntz")
    assert by_group(holiday_flag(df, days, "ts"), "is_holiday")["a"][:, 0].tolist() == [0, 1, 0, 0, 0]


def test_state_stream_keeps_the_last_rows(spark, tmp_path):
    df = series(spark, {"a": range(30), "b": range(4)})
    src, state, ckpt = (str(tmp_path / n) for n in ("src", "state", "ckpt"))
    cut = T0 + dt.timedelta(20)
    for part in (df.filter(F.col("ts") < cut), df.filter(F.col("ts") >= cut)):
        part.coalesce(1).write.mode("append").parquet(src)
        start_state_stream(spark.readStream.schema(df.schema).parquet(src), SPEC, 7, state, ckpt).awaitTermination(120)
    got = by_group(read_state(spark, state), "y", "pos")
    want = by_group(seasonal_state(df, SPEC, 7), "y", "pos")
    assert got["a"].tolist() == want["a"].tolist() and got["b"].tolist() == want["b"].tolist()


def test_checkpoints_use_the_named_folder(spark):
    ensure_checkpoint_dir(spark)
    out = materialize(spark.range(100).withColumn("s", F.lit("abc")))
    assert out.count() == 100 and written_bytes(out) > 300
    assert written_bytes(spark.range(3)) is None
    assert SeriesSpec(group="g").by == ["g"]
