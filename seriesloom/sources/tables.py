"""Reading tables and settling their column types."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seriesloom.operators.series import NTZ

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def load_table(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", schema=None) -> DataFrame:
    """CSV (with a header) or Parquet, by the end of the name.

    CSV columns are read as strings, so that no extra pass guesses types; see ``numeric_coerce``.
    """
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith((".csv", ".csv.gz", ".txt", ".tsv")):
        reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
        return (reader.schema(schema) if schema is not None else reader).csv(path)
    raise ValueError(f"unknown table format: {path}")


#: What counts as a number: no type suffixes, which Java would take ("12F", "7d").
_NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))\s*$"


def _number(c: str):
    return F.when(F.col(c).rlike(_NUMBER), F.col(c).try_cast("double"))


def numeric_coerce(df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn string columns into numbers where every value is one; the target is forced.

    One aggregate over all candidate columns decides.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    asked = [c for c in strings if (columns is None or c in columns) and c != target]
    whole: dict[str, bool] = {}
    if asked:
        bad = [F.count_if(F.col(c).isNotNull() & _number(c).isNull()).alias(c) for c in asked]
        row = df.agg(*bad).first()
        whole = {c: row[c] == 0 for c in asked}
    put = {c: _number(c) for c, ok in whole.items() if ok}
    if target is not None:
        put[target] = _number(target)
    return df.withColumns(put) if put else df


def date_parse(df: DataFrame, column: str, fmt: str | None = None, strict: bool = True) -> DataFrame:
    """Parse a date column. ``strict`` fails the query on a bad value, otherwise it becomes NULL."""
    f = F.lit(fmt) if fmt else None
    parse = F.to_timestamp_ntz if strict else F.try_to_timestamp
    c = F.col(column)
    parsed = parse(c, f) if f is not None else (c.cast(NTZ) if strict else c.try_cast(NTZ))
    if strict:
        bad = c.isNotNull() & parsed.isNull()
        parsed = F.when(bad, F.raise_error(F.concat(F.lit("not a date: "), c.cast("string"))).cast(NTZ)).otherwise(parsed)
    return df.withColumn(column, parsed.cast(NTZ))


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL."""
    put = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.col(f.name)
            put[f.name] = F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
    return df.withColumns(put) if put else df


def table_preview(df: DataFrame, order: Sequence[str] = (), n: int = 10) -> DataFrame:
    """The first ``n`` rows, numbers cleaned."""
    return clean_numbers(df.orderBy(*order) if order else df).limit(n)


def table_shape(df: DataFrame) -> DataFrame:
    """One row per column: name, type and the number of rows of the table."""
    cols = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("dtype")) for n, t in df.dtypes])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(cols).alias("_c")).select("_c.column", "_c.dtype", "n_rows")


def group_candidates(df: DataFrame, approximate: bool = False) -> DataFrame:
    """String columns that could name a series: 2 to 50 values, or fewer than 5 % distinct.

    Columns named like dates are left out. Each column is made distinct before it is
    counted, so neither a frequent value nor a wide column gathers in one task.
    """
    skip = ("date", "time", "timestamp")
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not any(k in f.name.lower() for k in skip)]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n_unique bigint, n_rows bigint, is_candidate boolean")
    if approximate:
        wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.approx_count_distinct(c).alias(c) for c in columns])
        counts = wide.select("n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_unique")) for c in columns])).alias("_s"))
        counts = counts.select("_s.column", "_s.n_unique", "n_rows")
    else:
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])).alias("_s")).select("_s.*")
        per_value = cells.groupBy("column", "v").agg(F.count(F.lit(1)).alias("_n"))
        counts = per_value.groupBy("column").agg(F.count("v").alias("n_unique"), F.sum("_n").alias("n_rows"))
    rule = F.col("n_unique").between(2, 50) | (F.col("n_unique") / F.col("n_rows") < 0.05)
    return counts.select("column", "n_unique", "n_rows", rule.alias("is_candidate"))


def duplicate_dates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys (series and timestamp) that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
