"""Missing values, outliers, transformation, features and differences, in this order."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from seriesloom.functions.features import date_features, diff_regular, diff_seasonal, lag_features, rolling_features
from seriesloom.functions.transforms import transform
from seriesloom.operators.clean import fill_missing, nan_to_null
from seriesloom.operators.outliers import FLAG, flag_outliers, treat_outliers
from seriesloom.operators.series import drop_incomplete
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec


@dataclass(frozen=True)
class PreprocessConfig:
    missing: str | None = None
    missing_columns: Sequence[str] = field(default=())
    outliers: str | None = None
    outlier_action: str = "remove"
    threshold: float = 1.5
    transformation: str = "none"
    lags: Sequence[int] = field(default=())
    windows: Sequence[int] = field(default=())
    date_parts: Sequence[str] = field(default=())
    diff_order: int = 0
    seasonal_diff: int = 0


def preprocess(df: DataFrame, spec: SeriesSpec, cfg: PreprocessConfig) -> tuple[DataFrame, DataFrame]:
    """The processed rows, and one row of counts: rows before, after and removed, cells filled, outliers treated.

    The table is written once after the steps that the counts look at, so that counting does not run them again.
    """
    columns = list(cfg.missing_columns or [spec.y])
    before = df.agg(F.count(F.lit(1)).alias("original_rows"), _missing(columns))
    out = df
    if cfg.missing:
        out = materialize(fill_missing(nan_to_null(out, columns), spec, cfg.missing, columns))
    else:
        before = before.withColumn("missing_handled", F.lit(0).cast("long"))
    flagged = None
    if cfg.outliers:
        flagged = flag_outliers(out, spec, cfg.outliers, cfg.threshold).agg(F.count_if(F.col(FLAG)).alias("outliers_handled"))
        out = treat_outliers(out, spec, cfg.outliers, cfg.outlier_action, cfg.threshold)
    out = transform(out, spec, cfg.transformation)
    made = set(out.columns)
    if cfg.lags:
        out = lag_features(out, spec, cfg.lags)
    if cfg.windows:
        out = rolling_features(out, spec, cfg.windows)
    if cfg.date_parts:
        out = date_features(out, spec.ts, cfg.date_parts)
    created = [c for c in out.columns if c not in made]
    if created:
        out = drop_incomplete(out)
    if cfg.diff_order:
        out = diff_regular(out, spec, cfg.diff_order)
    if cfg.seasonal_diff:
        out = diff_seasonal(out, spec, cfg.seasonal_diff)
    if cfg.diff_order or cfg.seasonal_diff:
        out = drop_incomplete(out)
    out = materialize(out)
    first = before.first()
    counts = out.agg(F.count(F.lit(1)).alias("processed_rows"))
    report = counts.select(
        F.lit(first["original_rows"]).cast("long").alias("original_rows"), "processed_rows",
        (F.lit(first["original_rows"]) - F.col("processed_rows")).alias("removed_rows"),
        F.lit(first["missing_handled"]).cast("long").alias("missing_handled"),
        F.lit(flagged.first()[0] if flagged is not None else 0).cast("long").alias("outliers_handled"),
        F.lit(",".join(created)).alias("features_created"),
    )
    return out, report


def _missing(columns: Sequence[str]):
    flags = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in columns]
    return reduce(lambda a, b: a + b, flags).alias("missing_handled")
