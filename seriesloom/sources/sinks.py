"""Shaping and writing results. Forecast tables are long: model, series, ts, yhat, bounds."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

BOUNDS = ("lo95", "hi95", "lo80", "hi80")


def _field(name: str):
    return F.transform("_s", lambda s: s[name])


def forecast_documents(forecasts: DataFrame, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """One row per model and series with parallel arrays; an array is as long as the horizon."""
    bounds = [b for b in BOUNDS if b in forecasts.columns]
    steps = F.sort_array(F.collect_list(F.struct(F.col(ts).alias("ts"), "yhat", *bounds)))
    docs = forecasts.groupBy("model", *by).agg(steps.alias("_s"))
    return docs.select(
        "model", *by, _field("ts").alias("dates"), _field("yhat").alias("values"), *[_field(b).alias(b) for b in bounds],
    )


def export_long(documents: DataFrame, by: Sequence[str] = (), best: str | None = None) -> DataFrame:
    """Documents to rows (date, model, forecast, bounds); only the best model unless ``best`` is None."""
    bounds = [b for b in BOUNDS if b in documents.columns]
    docs = documents.filter(F.col("model") == best) if best is not None else documents
    zipped = F.posexplode(F.arrays_zip("dates", "values", *bounds)).alias("_i", "_z")
    return docs.select("model", *by, zipped).select(
        "model", *by, F.col("_z.dates").alias("date"), F.col("_z.values").alias("forecast"), *[F.col(f"_z.{b}").alias(b) for b in bounds]
    )


def export_with_history(long: DataFrame, history: DataFrame, ts: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Forecast rows and history rows (model 'historical', actual filled, forecast NULL) in one table."""
    past = history.select(*by, F.col(ts).alias("date"), F.col(y).alias("actual")).withColumn("model", F.lit("historical"))
    return long.unionByName(past, allowMissingColumns=True)


def export_json(forecasts: DataFrame, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """One JSON text per model and series."""
    docs = forecast_documents(forecasts, by, ts)
    fields = [c for c in docs.columns]
    return docs.select("model", *by, F.to_json(F.struct(*fields)).alias("document"))


def select_models(forecasts: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """Rows whose full model name, or its part before " (", is chosen; all rows if none is."""
    hit = F.split_part("model", F.lit(" ("), F.lit(1)).isin(list(chosen)) | F.col("model").isin(list(chosen))
    if not chosen or forecasts.filter(hit).isEmpty():
        return forecasts
    return forecasts.filter(hit)


def write_splits(df: DataFrame, path: str, by: Sequence[str] = (), fmt: str = "parquet", split: str = "split") -> None:
    """One folder per series and part, so that later reads prune to what they need.

    Rebalancing gives small parts one file and splits a hot series over several.
    """
    writer = df.hint("rebalance", *by, split).write.mode("overwrite").partitionBy(*by, split)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def results_append(results: DataFrame, path: str, run_id: str) -> None:
    """Add the results of a run to a table that only grows."""
    results.withColumn("run_id", F.lit(run_id)).withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)
