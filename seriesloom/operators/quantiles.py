"""Exact quantiles by rank, without holding the values of a group in one task."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from seriesloom.operators.index import SEG, order_rows
from seriesloom.operators.joins import keyed_join


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles of the non-missing values of each group.

    Equal values are counted before anything is sorted, so a value that fills a third
    of the table is one row. The distinct values are range-partitioned, and only the
    segments that hold a wanted rank are looked at again. One row per group that has
    a value; columns ``names`` (default ``q0``, ``q1``, ...).
    """
    by = list(by)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    clean = df.select(*by, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    counts = clean.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_w"))
    ordered = order_rows(counts, by, ["_v"], partitions)
    weights = ordered.rows.groupBy(*by, SEG).agg(F.sum("_w").alias("_sw"))
    key = by or [F.lit(0)]
    run = W.partitionBy(*key).orderBy(SEG).rowsBetween(W.unboundedPreceding, 0)
    segs = weights.withColumn("_before", F.sum("_sw").over(run) - F.col("_sw")).withColumn(
        "_total", F.sum("_sw").over(W.partitionBy(*key))
    )

    def rank(p: float):
        return F.lit(float(p)) * (F.col("_total") - 1)

    wanted = F.array(*[f(rank(p)) for p in probs for f in (F.floor, F.ceil)])
    hit = segs.filter(
        F.exists(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_sw")))
    ).drop("_sw")
    rows = keyed_join(ordered.rows, hit, [*by, SEG], "inner")
    upto = W.partitionBy(*by, SEG).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_hi", F.col("_before") + F.sum("_w").over(upto)).withColumn(
        "_lo", F.col("_hi") - F.col("_w")
    )
    aggs = []
    for i, p in enumerate(probs):
        for tag, f in (("l", F.floor), ("h", F.ceil)):
            r = f(rank(p))
            aggs.append(
                F.max(F.when((r >= F.col("_lo")) & (r < F.col("_hi")), F.col("_v"))).alias(f"_{tag}{i}")
            )
    aggs.append(F.max("_total").alias("_total"))
    out = rows.groupBy(*by).agg(*aggs)
    cols = []
    for i, (p, n) in enumerate(zip(probs, names)):
        frac = rank(p) - F.floor(rank(p))
        cols.append((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * frac).alias(n))
    return out.select(*by, *cols)
