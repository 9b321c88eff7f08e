"""One row per series with everything that alerts and suggestions look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesloom.operators.clean import missing_summary
from seriesloom.operators.joins import series_join
from seriesloom.operators.profile import date_range_freq, describe_target, outlier_share, trend_linear
from seriesloom.operators.spectral import seasonality_hybrid
from seriesloom.operators.stationarity import stationarity_adf, stationarity_kpss
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec


def series_report(df: DataFrame, spec: SeriesSpec, freq: str = "D") -> DataFrame:
    """Range, missing values, moments, trend, outliers, seasonality and stationarity of each series.

    The rows are read from one written copy, which every section scans for the columns it needs.
    """
    rows = materialize(df.select(*spec.by, spec.ts, *spec.tie, spec.y))
    sections = [
        missing_summary(rows, spec, freq),
        describe_target(rows, spec),
        trend_linear(rows, spec),
        outlier_share(rows, spec),
        seasonality_hybrid(rows, spec),
        stationarity_adf(rows, spec).drop("n"),
        stationarity_kpss(rows, spec).drop("n"),
    ]
    out = date_range_freq(rows, spec)
    for s in sections:
        out = series_join(out, s, spec.by)
    return out.withColumn("stationary", F.col("adf_stationary"))
