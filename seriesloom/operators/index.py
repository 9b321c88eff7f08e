"""Dense row positions and overlapping blocks for windows over long series.

A window partitioned by the series key alone moves a whole series to one task. Here
rows are range-partitioned by (series, order) instead, so that a hot series is
spread over many tasks; positions come from per-partition counts; and windows that
need only a bounded number of neighbours run per (series, block), each block being
padded with copies of the neighbouring rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesloom.operators.joins import keyed_join
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec

#: Rows of one series that a window task handles at most (before padding).
BLOCK_ROWS = 1 << 17

SEG, POS, IDX, LEN, BLK, OWN = "_seg", "_pos", "_idx", "_len", "_blk", "_own"


@dataclass
class Ordered:
    """Rows in series order, held in range segments, with a summary per segment."""

    rows: DataFrame
    by: list[str]

    @cached_property
    def segs(self) -> DataFrame:
        """Per series at most one row per range partition: where its rows start, and how many precede them."""
        per_seg = self.rows.groupBy(*self.by, SEG).agg(F.min(POS).alias("_start"), F.count(F.lit(1)).alias("_n"))
        whole = W.partitionBy(*(self.by or [F.lit(0)]))
        before = whole.orderBy(SEG).rowsBetween(W.unboundedPreceding, 0)
        return materialize(
            per_seg.withColumn("_off", F.sum("_n").over(before) - F.col("_n")).withColumn(LEN, F.sum("_n").over(whole))
        )

    def indexed(self) -> DataFrame:
        """Rows with their 0-based position ``_idx`` and the series length ``_len``."""
        out = keyed_join(self.rows, self.segs, [*self.by, SEG], "inner")
        return out.withColumn(IDX, F.col("_off") + F.col(POS) - F.col("_start")).drop(
            SEG, POS, "_off", "_start", "_n"
        )

    def lengths(self) -> DataFrame:
        return self.segs.groupBy(*self.by).agg(F.max(LEN).alias(LEN))


def order_rows(df: DataFrame, by: Sequence[str], order: Sequence[str],
               partitions: int | None = None) -> Ordered:
    """Range-partition and sort by (``by``, ``order``), then number rows per segment."""
    by = list(by)
    keys = [*by, *order]
    ranged = (
        df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    )
    placed = ranged.sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    # The id holds the partition number above bit 33 and the row's place in it below.
    rows = materialize(
        placed.withColumn(SEG, F.shiftright("_mid", 33))
        .withColumn(POS, F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )
    return Ordered(rows, by)


def series_order(df: DataFrame, spec: SeriesSpec) -> list[Column]:
    """Order within a series: time, then the tie columns or else a hash of the row's content."""
    rest = [c for c in df.columns if c not in (*spec.by, spec.ts)]
    return [F.col(spec.ts), *([F.col(c) for c in spec.tie] or ([F.xxhash64(*rest)] if rest else []))]


def order_series(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] | None = None,
                 partitions: int | None = None) -> Ordered:
    """Order a series by time; ties by ``spec.tie`` or else by the content of the row."""
    keep = list(dict.fromkeys([*spec.by, spec.ts, *spec.tie, *(columns or [c for c in df.columns])]))
    out = df.select(*keep)
    tie = list(spec.tie)
    if not tie:
        rest = [c for c in keep if c not in (*spec.by, spec.ts)]
        if rest:
            out = out.withColumn("_tie", F.xxhash64(*rest))
            tie = ["_tie"]
    ordered = order_rows(out, spec.by, [spec.ts, *tie], partitions)
    if "_tie" in ordered.rows.columns:
        ordered.rows = ordered.rows.drop("_tie")
    return ordered


def indexed_rows(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with ``_idx`` and ``_len``. A frame that carries them already is not ordered again,
    so one ordering can serve many operators; it may also be a run of rows of each series."""
    if IDX in df.columns and LEN in df.columns:
        return df.select(*dict.fromkeys([*spec.by, spec.ts, *spec.tie, *columns, IDX, LEN])) if columns else df
    return order_series(df, spec, columns).indexed()


def halo_blocks(indexed: DataFrame, back: int, ahead: int = 0, block: int | None = None) -> DataFrame:
    """Copy rows near a block border into the neighbouring block.

    After this every row with ``_own`` true sees its ``back`` previous and ``ahead``
    following rows inside its own (series, ``_blk``).
    """
    size = max(block or BLOCK_ROWS, back, ahead, 1)
    b = F.floor(F.col(IDX) / F.lit(size)).cast("long")
    within = F.col(IDX) - b * F.lit(size)
    last = F.floor((F.col(LEN) - 1) / F.lit(size)).cast("long")
    to_next = (within >= size - back) & (b < last)
    to_previous = (within < ahead) & (b > 0)
    own, following, preceding = (
        F.struct((b + k).alias("b"), F.lit(k == 0).alias("own")) for k in (0, 1, -1)
    )
    # Spelt out as four cases, because plain arrays stay inside generated code.
    if back and ahead:
        places = (
            F.when(to_next & to_previous, F.array(own, following, preceding))
            .when(to_next, F.array(own, following)).when(to_previous, F.array(own, preceding)).otherwise(F.array(own))
        )
    elif back:
        places = F.when(to_next, F.array(own, following)).otherwise(F.array(own))
    else:
        places = F.when(to_previous, F.array(own, preceding)).otherwise(F.array(own))
    out = indexed.withColumn("_h", F.explode(places))
    return out.select("*", F.col("_h.b").alias(BLK), F.col("_h.own").alias(OWN)).drop("_h")


def block_window(by: Sequence[str]):
    return W.partitionBy(*by, BLK).orderBy(IDX)


def windowed(df: DataFrame, spec: SeriesSpec, make: Callable[[object], dict[str, Column]], back: int,
             ahead: int = 0, columns: Sequence[str] | None = None, block: int | None = None,
             keep_index: bool = False) -> DataFrame:
    """Add window expressions that look at a bounded number of neighbouring rows.

    ``make(window)`` gives the new columns for a window ordered inside one block.
    """
    keep_index = keep_index or IDX in df.columns
    rows = indexed_rows(df, spec, columns)
    blocks = halo_blocks(rows, back, ahead, block)
    exprs = make(block_window(spec.by))
    out = blocks.select("*", *[e.alias(n) for n, e in exprs.items()]).filter(F.col(OWN)).drop(BLK, OWN)
    return out if keep_index else out.drop(IDX, LEN)
