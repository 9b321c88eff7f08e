"""Time-ordered train / validation / test splits."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.operators.index import IDX, LEN, indexed_rows
from seriesloom.operators.joins import attach
from seriesloom.operators.series import NTZ
from seriesloom.spec import SeriesSpec

RATIOS = (0.7, 0.15, 0.15)


def _made_here(df: DataFrame) -> list[str]:
    """Index columns to drop again, unless the input brought them."""
    return [] if IDX in df.columns else [IDX, LEN]


def _part_of(n: Column, train: float, val: float) -> Column:
    """Whole rows of a share: train and validation are cut down, test takes the rest."""
    n_train = F.floor(n * F.lit(float(train)))
    n_val = F.floor(n * F.lit(float(val)))
    return F.when(F.col(IDX) < n_train, "train").when(F.col(IDX) < n_train + n_val, "val").otherwise("test")


def split_ratio(df: DataFrame, spec: SeriesSpec, ratios: Sequence[float] = RATIOS, out: str = "split") -> DataFrame:
    """Label the rows of each series by their position; without a group the table is one series."""
    rows = indexed_rows(df, spec)
    return rows.withColumn(out, _part_of(F.col(LEN), ratios[0], ratios[1])).drop(*_made_here(df))


split_ratio_grouped = split_ratio


def split_cutoff(df: DataFrame, spec: SeriesSpec, cutoff: str, ratios: Sequence[float] = RATIOS,
                 out: str = "split") -> DataFrame:
    """Train up to the cut-off; the rest by val/(val+test). Series without a train row split by ratio."""
    at = F.lit(cutoff).cast(NTZ)
    counts = df.groupBy(*spec.by).agg(F.count_if(F.col(spec.ts) <= at).alias("_ntr"))
    rows = attach(indexed_rows(df, spec), counts, spec.by)
    rest = ratios[1] + ratios[2]
    share = ratios[1] / rest if rest > 0 else 0.5
    n_val = F.floor((F.col(LEN) - F.col("_ntr")) * F.lit(float(share)))
    by_date = F.when(F.col(IDX) < F.col("_ntr"), "train").when(F.col(IDX) < F.col("_ntr") + n_val, "val").otherwise("test")
    label = F.when(F.col("_ntr") > 0, by_date).otherwise(_part_of(F.col(LEN), ratios[0], ratios[1]))
    return rows.withColumn(out, label).drop("_ntr", *_made_here(df))


def split_cv(df: DataFrame, spec: SeriesSpec, folds: int = 5, mode: str = "expanding") -> DataFrame:
    """Rolling-origin folds: one row per (fold, row used in it), with its part.

    The series is cut into ``folds`` test pieces of n // (folds + 1) rows at its end.
    ``expanding`` trains on all rows before a piece, ``sliding`` on as many as the first fold has.
    """
    if mode not in ("expanding", "sliding"):
        raise ValueError("mode is 'expanding' or 'sliding'")
    rows = indexed_rows(df, spec)
    size = F.floor(F.col(LEN) / (folds + 1))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    start = F.col(LEN) - (folds - F.col("fold") + 1) * size
    first = F.lit(0) if mode == "expanding" else (F.col("fold") - 1) * size
    rows = rows.filter((F.col(IDX) >= first) & (F.col(IDX) < start + size))
    return rows.withColumn("split", F.when(F.col(IDX) < start, "train").otherwise("test")).drop(*_made_here(df))


def split_sizes(df: DataFrame, spec: SeriesSpec, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """Planned rows per part, each cut down to whole rows, and whether features and groups are used."""
    n = df.groupBy(*spec.by).agg(F.count(F.lit(1)).alias("n_total"))
    names = ("n_train", "n_val", "n_test")
    return n.select(
        *spec.by, "n_total",
        *[F.floor(F.col("n_total") * F.lit(float(r))).alias(c) for c, r in zip(names, ratios)],
        F.lit(bool(spec.features)).alias("has_features"),
        F.lit(len(spec.features)).alias("n_features"),
        F.lit(bool(spec.group)).alias("has_groups"),
    )


def split_checks(df: DataFrame, spec: SeriesSpec, ratios: Sequence[float] = RATIOS, horizon: int = 30,
                 levels: Sequence[float] = (0.95, 0.8), min_rows: int = 0, needs_val: bool = False) -> DataFrame:
    """One row per series and broken rule; limits are fixed values."""
    n = df.groupBy(*spec.by).agg(F.count(F.lit(1)).alias("n_total"))
    total = float(sum(ratios))
    limit = F.floor(F.col("n_total") * F.lit(0.3))
    rules = [
        ("sizes_do_not_sum_to_one", F.lit(abs(total - 1.0) > 0.01), F.lit(total)),
        ("train_too_small", F.lit(ratios[0] < 0.5), F.lit(float(ratios[0]))),
        ("test_too_small", F.lit(ratios[2] < 0.1), F.lit(float(ratios[2]))),
        ("horizon_too_long", F.lit(horizon) > limit, limit.cast("double")),
        ("too_few_rows", F.col("n_total") < F.lit(min_rows), F.col("n_total").cast("double")),
        ("validation_part_needed", F.lit(needs_val and ratios[1] == 0), F.lit(float(ratios[1]))),
    ]
    rules += [("level_out_of_range", F.lit(not 0.0 < ci < 1.0), F.lit(float(ci))) for ci in levels]
    found = F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule"), value.alias("value"))) for name, cond, value in rules])
    return n.select(*spec.by, "n_total", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_r")).select(
        *spec.by, "n_total", "_r.rule", "_r.value"
    )
