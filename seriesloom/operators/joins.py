"""Attaching small per-series tables to large row tables."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from seriesloom.session import materialize, written_bytes

#: Largest measured size, in bytes, of a table that may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def number_or_null(c: str | Column) -> Column:
    """The value, or NULL where it is NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c.cast("double")), c)


def keyed_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left",
               limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a table of measured size on null-safe keys.

    ``small`` is written out and measured first, unless it has been already. Within ``limit`` it is broadcast,
    so ``big`` is not shuffled at all. Beyond it both sides are shuffled, with an
    exchange of its own under ``small`` so that adaptive execution may split a hot key.
    """
    if written_bytes(small) is None:
        small = materialize(small)
    keys = list(keys)
    if not keys:
        raise ValueError("keyed_join needs at least one key; use attach() for one-row tables")
    renamed = small.select(
        *[F.col(k).alias(f"_jk_{k}") for k in keys], *[F.col(c) for c in small.columns if c not in keys]
    )
    if written_bytes(small) <= limit:
        renamed = F.broadcast(renamed)
    else:
        renamed = renamed.repartition(*[f"_jk_{k}" for k in keys])
    cond = reduce(lambda a, b: a & b, [big[k].eqNullSafe(renamed[f"_jk_{k}"]) for k in keys])
    out = big.join(renamed, cond, how)
    return out.drop(*[f"_jk_{k}" for k in keys])


def side_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join of two tables with few rows per key (statistics, grids, summaries).

    No key is hot on either side, so the choice of join is left to Spark.
    """
    other = right.select(
        *[F.col(k).alias(f"_jk_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_jk_{k}"]) for k in keys])
    return left.join(other, cond, how).drop(*[f"_jk_{k}" for k in keys])


def series_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """``side_join`` on the series key; without a group the one row of ``right`` becomes literals."""
    return side_join(left, right, by, how) if by else attach(left, right, by, how)


def attach(big: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Add the columns of a one-row-per-series table to every row of the series.

    Without a group the table has one row, which becomes literals in the plan.
    """
    if by:
        return keyed_join(big, stats, by, how)
    row = stats.first()
    if row is None:
        if how == "inner":
            return big.limit(0)
        row = {c: None for c in stats.columns}
    return big.select("*", *[_literal(row[f.name], f.dataType).alias(f.name) for f in stats.schema.fields])


def _literal(value, kind: T.DataType) -> Column:
    """A value of any type as a literal, structs and arrays in it too."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)
