"""Session helpers: defaults, and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T


def build_session(app: str = "seriesloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only a local session gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="seriesloom-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def materialize(df: DataFrame, compression: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and go on from there.

    Used where two branches of a plan must see the very same rows (range
    partitions, fitted statistics), and to survive the loss of executors. A Parquet
    table is smaller than a checkpoint of rows, later scans read only the columns they
    need, and its size is known to the planner. ``compression`` is Parquet's; zstd keeps less
    memory outside the heap than the usual codec where rows hold megabytes. ``options`` are the writer's.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    seen = Observation()
    size = F.coalesce(F.sum(_row_bytes(df)), F.lit(0).cast("long"))
    df.observe(seen, size.alias("bytes")).write.options(**options).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_bytes = int(seen.get["bytes"])
    return out


def written_bytes(df: DataFrame) -> int | None:
    """Size noted when ``df`` was materialised, or None for any other frame."""
    return getattr(df, "_written_bytes", None)


def _value_bytes(c: Column, kind: T.DataType) -> Column:
    """Rough size of a value: 16, and the real length of all strings, arrays and maps in it, at any depth."""
    fixed = F.lit(16).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return fixed + F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        return reduce(lambda a, f: a + _value_bytes(c[f.name], f.dataType), kind.fields, fixed)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            inner = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + _value_bytes(x, kind.elementType))
        else:
            inner = F.greatest(F.size(c), F.lit(0)).cast("long") * 16
        return fixed + F.coalesce(inner, F.lit(0).cast("long"))
    if isinstance(kind, T.MapType):
        return _value_bytes(F.map_keys(c), T.ArrayType(kind.keyType)) + _value_bytes(F.map_values(c), T.ArrayType(kind.valueType))
    return fixed


def _row_bytes(df: DataFrame) -> Column:
    return reduce(lambda a, f: a + _value_bytes(F.col(f"`{f.name}`"), f.dataType), df.schema.fields, F.lit(16).cast("long"))
