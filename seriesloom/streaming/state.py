"""Keeping the state of the naive models up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesloom.forecast.baseline import state_update
from seriesloom.operators.profile import present
from seriesloom.spec import SeriesSpec


def _epochs(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as err:  # the folder does not exist before the first batch
        if "PATH_NOT_FOUND" in str(err) or "UNABLE_TO_INFER_SCHEMA" in str(err):
            return None
        raise


def read_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The state after the latest batch (before batch ``before``), without the batch number."""
    table = _epochs(spark, path)
    if table is None:
        return None
    if before is not None:
        table = table.filter(F.col("epoch") < before)
    last = table.agg(F.max("epoch")).first()[0]
    return None if last is None else table.filter(F.col("epoch") == last).drop("epoch")


def apply_batch(batch: DataFrame, epoch: int, spec: SeriesSpec, period: int, path: str) -> None:
    """Merge one batch. Running a batch again writes the same folder again, so retries do no harm.

    Once the batch is written, folders older than the one before it are removed; that one stays for a retry.
    """
    spark = batch.sparkSession
    keep = [*spec.by, spec.ts, *spec.tie, spec.y]
    new = present(batch, spec).select(*keep)
    old = read_state(spark, path, before=epoch)
    merged = state_update(old if old is not None else new.limit(0), new, spec, period)
    merged.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    _forget(spark, path, epoch)


def _forget(spark: SparkSession, path: str, epoch: int) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("epoch="))
    before = [e for e in done if e < epoch]
    for e in before[:-1]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={e}"), True)


def start_state_stream(stream: DataFrame, spec: SeriesSpec, period: int, path: str, checkpoint: str, trigger: dict | None = None):
    """Follow ``stream`` and keep the last ``period`` rows of each series under ``path``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, epoch: apply_batch(batch, epoch, spec, period, path))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
