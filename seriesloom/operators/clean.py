"""Missing values and the date grid."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesloom.operators.index import IDX, POS, SEG, order_series
from seriesloom.operators.joins import attach, keyed_join, number_or_null, series_join, side_join
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.operators.series import NTZ, dedupe_keep_last, micros, modal_step
from seriesloom.spec import SeriesSpec

#: Accepted spellings of the fill methods (fixed values).
METHODS = {
    "forward_fill": "forward_fill", "ffill": "forward_fill",
    "backward_fill": "backward_fill", "bfill": "backward_fill",
    "interpolate": "interpolate", "mean": "mean", "median": "median", "drop": "drop",
}
#: Length of one step: (unit, multiple) by frequency code.
STEPS = {
    "15T": ("MINUTE", 15), "30T": ("MINUTE", 30), "H": ("HOUR", 1), "D": ("DAY", 1), "W": ("DAY", 7),
    "M": ("MONTH", 1), "Q": ("MONTH", 3), "Y": ("MONTH", 12),
}
_CHUNK = 4096


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN is a missing value: make it NULL so that aggregates skip it."""
    return df.withColumns({c: number_or_null(c) for c in columns})


def missing_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of missing cells in each column."""
    flags = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns]
    return df.agg(*flags).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])).alias("_s")
    ).select("_s.*")


def step_number(first: Column, ts: Column, freq: str) -> Column:
    """Whole steps from ``first`` to ``ts``."""
    unit, k = STEPS[freq]
    return F.floor(F.timestamp_diff(unit, first, ts) / F.lit(k)).cast("long")


def add_steps(ts: Column, n: Column, freq: str) -> Column:
    unit, k = STEPS[freq]
    return F.timestamp_add(unit, n * F.lit(k), ts).cast(NTZ)


def date_grid(df: DataFrame, spec: SeriesSpec, freq: str = "D") -> DataFrame:
    """Every step from the first to the last timestamp of each series.

    Exploded in two rounds with a shuffle between, so no row holds a long array and
    no task makes a whole long series.
    """
    ends = df.groupBy(*spec.by).agg(F.min(spec.ts).alias("_a"), F.max(spec.ts).alias("_b")).filter(F.col("_a").isNotNull())
    total = ends.withColumn("_n", step_number(F.col("_a"), F.col("_b"), freq))
    chunks = total.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / _CHUNK))))
    spread = chunks.repartition(*spec.by, "_c")
    steps = spread.withColumn(
        "_k",
        F.explode(F.sequence(F.col("_c") * _CHUNK, F.least(F.col("_n"), F.col("_c") * _CHUNK + (_CHUNK - 1)))),
    )
    return steps.select(*spec.by, add_steps(F.col("_a"), F.col("_k").cast("int"), freq).alias(spec.ts))


def missing_summary(df: DataFrame, spec: SeriesSpec, freq: str = "D") -> DataFrame:
    """Missing values, and grid length minus row count (negative when dates repeat)."""
    y = F.col(spec.y).cast("double")
    out = df.groupBy(*spec.by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(y.isNull() | F.isnan(y)).alias("missing_values"),
        F.min(spec.ts).alias("_a"),
        F.max(spec.ts).alias("_b"),
    )
    grid = step_number(F.col("_a"), F.col("_b"), freq) + 1
    return out.select(
        *spec.by,
        "n_rows",
        "missing_values",
        (F.col("missing_values") / F.nullif(F.col("n_rows"), F.lit(0)) * 100).alias("missing_pct"),
        F.when(F.col("n_rows") > 1, grid - F.col("n_rows")).otherwise(0).alias("missing_dates"),
    )


def date_gaps(df: DataFrame, spec: SeriesSpec, freq: str = "D") -> DataFrame:
    """Distinct timestamps against the grid: duplicates, absent grid dates, modal step."""
    dates = df.filter(F.col(spec.ts).isNotNull())
    ends = dates.groupBy(*spec.by).agg(F.min(spec.ts).alias("_a"), F.max(spec.ts).alias("_b"), F.count(F.lit(1)).alias("n_rows"))
    # Distinct first: the shuffle is on (series, timestamp), and repeats combine map-side.
    unique = dates.select(*spec.by, spec.ts).distinct()
    placed = attach(unique, ends, spec.by)
    k = step_number(F.col("_a"), F.col(spec.ts), freq)
    on_grid = add_steps(F.col("_a"), k.cast("int"), freq) == F.col(spec.ts)
    out = placed.groupBy(*spec.by).agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.max("n_rows").alias("n_rows"),
        F.count_if(on_grid).alias("_on"),
        F.max(step_number(F.col("_a"), F.col("_b"), freq) + 1).alias("expected_points"),
    )
    out = out.select(
        *spec.by,
        "n_rows",
        "n_unique",
        (F.col("n_rows") - F.col("n_unique")).alias("n_duplicates"),
        "expected_points",
        (F.col("expected_points") - F.col("_on")).alias("missing_points"),
    )
    return series_join(out, modal_step(df, spec).withColumnRenamed("step_seconds", "mode_step_seconds"), spec.by)


def absent_dates(df: DataFrame, spec: SeriesSpec, freq: str = "D") -> DataFrame:
    """The grid dates that have no row."""
    keys = [*spec.by, spec.ts]
    return side_join(date_grid(df, spec, freq), df.select(*keys).distinct(), keys, "left_anti")


def fill_missing_dates(df: DataFrame, spec: SeriesSpec, freq: str = "D") -> DataFrame:
    """Insert rows for absent grid dates; their other columns are NULL. A NULL group is a series like any other."""
    return df.unionByName(absent_dates(df, spec, freq), allowMissingColumns=True)


def fill_ordered(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], method: str,
                 partitions: int | None = None) -> DataFrame:
    """Forward, backward or linear fill over gaps of any length.

    Inside a range segment a running window finds the neighbouring values; what lies
    beyond the segment comes from a summary with one row per segment.
    """
    columns = list(columns)
    ordered = order_series(nan_to_null(df, columns), spec, partitions=partitions)
    summary = ordered.rows.groupBy(*spec.by, SEG).agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(POS, c))).alias(f"_lst_{c}") for c in columns],
        *[F.min(F.when(F.col(c).isNotNull(), F.struct(POS, c))).alias(f"_fst_{c}") for c in columns],
    )
    key = spec.by or [F.lit(0)]
    before = W.partitionBy(*key).orderBy(SEG).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*key).orderBy(SEG).rowsBetween(1, W.unboundedFollowing)
    placed = side_join(summary, ordered.segs, [*spec.by, SEG], "inner")

    def at(prefix: str, c: str) -> Column:
        s = F.col(f"{prefix}_{c}")
        return F.when(s.isNotNull(), F.struct((F.col("_off") + s[POS] - F.col("_start")).alias("i"), s[c].alias("v")))

    carried = placed.select(
        *spec.by, SEG, "_start", "_off",
        *[F.last(at("_lst", c), ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns],
        *[F.first(at("_fst", c), ignorenulls=True).over(after).alias(f"_out_{c}") for c in columns],
    )
    rows = keyed_join(ordered.rows, carried, [*spec.by, SEG], "inner")
    rows = rows.withColumn(IDX, F.col("_off") + F.col(POS) - F.col("_start"))
    upto = W.partitionBy(*spec.by, SEG).orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    rest = W.partitionBy(*spec.by, SEG).orderBy(POS).rowsBetween(0, W.unboundedFollowing)
    seen = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(IDX).alias("i"), F.col(c).alias("v"))) for c in columns}
    back = {c: F.coalesce(F.last(seen[c], ignorenulls=True).over(upto), F.col(f"_in_{c}")) for c in columns}
    fore = {c: F.coalesce(F.first(seen[c], ignorenulls=True).over(rest), F.col(f"_out_{c}")) for c in columns}
    need = {}
    if method != "backward_fill":
        need.update({f"_p_{c}": back[c] for c in columns})
    if method != "forward_fill":
        need.update({f"_q_{c}": fore[c] for c in columns})
    rows = rows.select("*", *[e.alias(n) for n, e in need.items()])

    def value(c: str) -> Column:
        p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
        if method == "forward_fill":
            return p["v"]
        if method == "backward_fill":
            return q["v"]
        line = p["v"] + (q["v"] - p["v"]) * (F.col(IDX) - p["i"]) / F.nullif(q["i"] - p["i"], F.lit(0))
        return F.when(F.col(c).isNotNull(), F.col(c)).when(p.isNull(), None).when(q.isNull(), p["v"]).otherwise(line)

    return rows.select(*[value(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_forward(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    return fill_ordered(df, spec, columns or [spec.y], "forward_fill", **kw)


def fill_backward(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    return fill_ordered(df, spec, columns or [spec.y], "backward_fill", **kw)


def fill_interpolate(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    """Linear by row position; leading gaps stay, trailing gaps take the last value."""
    return fill_ordered(df, spec, columns or [spec.y], "interpolate", **kw)


def _fill_with(df: DataFrame, stats: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    out = attach(df, stats, by)
    return out.select(*[F.coalesce(F.col(c), F.col(f"_s_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_mean(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or [spec.y])
    df = nan_to_null(df, columns)
    stats = df.groupBy(*spec.by).agg(*[F.avg(c).alias(f"_s_{c}") for c in columns])
    return _fill_with(df, stats, spec.by, columns)


def fill_median(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or [spec.y])
    df = nan_to_null(df, columns)
    for c in columns:
        df = _fill_with(df, exact_quantiles(df, c, [0.5], spec.by, [f"_s_{c}"]), spec.by, [c])
    return df


def fill_drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def fill_missing(df: DataFrame, spec: SeriesSpec, method: str = "forward_fill",
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Fill by method name (long names and short spellings)."""
    try:
        name = METHODS[method]
    except KeyError:
        raise ValueError(f"unknown fill method {method!r}; choose from {sorted(METHODS)}") from None
    columns = list(columns or [spec.y])
    if name == "drop":
        return fill_drop(df, columns)
    if name == "mean":
        return fill_mean(df, spec, columns)
    if name == "median":
        return fill_median(df, spec, columns)
    return fill_ordered(df, spec, columns, name)


def reindex_fill(df: DataFrame, grid: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> DataFrame:
    """Values of the last row per date on the dates of ``grid``, then forward and backward fill."""
    columns = list(columns)
    keys = [*spec.by, spec.ts]
    last = dedupe_keep_last(df, spec).select(*keys, *columns)
    on_grid = side_join(grid.select(*keys), last, keys).select(*keys, *columns)
    plain = SeriesSpec(ts=spec.ts, y=spec.y, group=spec.group)
    return fill_backward(fill_forward(on_grid, plain, columns), plain, columns)
