"""Outlier detection and treatment. Missing values are skipped and never flagged."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.operators.joins import attach, series_join
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec

FLAG = "is_outlier"
#: Rows that share one copy of a forest's step function.
_ROWS_PER_TASK = 1 << 19


def iqr_bounds(df: DataFrame, spec: SeriesSpec, k: float = 1.5) -> DataFrame:
    q = exact_quantiles(df, spec.y, [0.25, 0.75], spec.by, ["q1", "q3"])
    spread = F.col("q3") - F.col("q1")
    return q.select(*spec.by, "q1", "q3", (F.col("q1") - k * spread).alias("lower"), (F.col("q3") + k * spread).alias("upper"))


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).alias(FLAG)


def outlier_iqr(df: DataFrame, spec: SeriesSpec, k: float = 1.5) -> DataFrame:
    """Adds ``lower``, ``upper`` and ``is_outlier``."""
    out = attach(df, iqr_bounds(df, spec, k).drop("q1", "q3"), spec.by)
    y = F.col(spec.y)
    return out.select("*", _flag((y < F.col("lower")) | (y > F.col("upper"))))


def outlier_zscore(df: DataFrame, spec: SeriesSpec, threshold: float = 1.5) -> DataFrame:
    """Adds ``zscore`` (population deviation) and ``is_outlier``; a constant series has none."""
    y = F.when(~F.isnan(spec.y), F.col(spec.y))
    stats = df.groupBy(*spec.by).agg(F.avg(y).alias("_mu"), F.stddev_pop(y).alias("_sd"))
    out = attach(df, stats, spec.by).withColumn("zscore", F.abs((y - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0))))
    return out.drop("_mu", "_sd").select("*", _flag(F.col("zscore") > threshold))


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points (Liu, Ting, Zhou 2008)."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _grow(values: np.ndarray, depth: int, limit: int, rng, cuts: list, leaves: list) -> None:
    """Split a sorted sample at random; in one dimension a tree is a list of cuts and leaf depths."""
    if depth >= limit or len(values) <= 1 or values[0] == values[-1]:
        leaves.append(depth + float(_average_path(len(values))))
        return
    cut = rng.uniform(values[0], values[-1])
    k = int(np.searchsorted(values, cut, side="left"))
    _grow(values[:k], depth + 1, limit, rng, cuts, leaves)
    cuts.append(cut)
    _grow(values[k:], depth + 1, limit, rng, cuts, leaves)


def outlier_isolation_forest(df: DataFrame, spec: SeriesSpec, contamination: float = 0.1, seed: int = 42,
                             trees: int = 100, sample: int = 256) -> DataFrame:
    """Adds ``score`` (higher is stranger) and ``is_outlier`` for the top share of scores.

    Every tree draws its own ``sample`` values from all rows of its series (all of a series with fewer), so the per-tree subsample of the
    method is the only bound. The sum of the trees is one step function of the value, which rows look up in blocks of bounded
    size, so neither a hot series nor a large forest meets in one task.
    """
    y = F.col(spec.y).cast("double")
    ok = y.isNotNull() & ~F.isnan(y)
    sizes = df.groupBy(*spec.by).agg(F.count_if(ok).alias("_cnt"))
    # Row numbers of a written table do not change when a task is run again, and they
    # spread even rows that are equal in every column.
    rows = materialize(attach(df, sizes, spec.by)).withColumn("_rid", F.monotonically_increasing_id())
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("_rid")), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("_draw", draw).drop("_rid")
    # Each row joins each tree with a chance that gives a tree a little more than ``sample`` rows; the trees' draws are independent hashes.
    chance = F.least(F.lit(1.0), F.lit(sample + 6.0 * sample**0.5) / F.greatest(F.col("_cnt"), F.lit(1)))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("_draw")), F.lit(1 << 30)) < chance * float(1 << 30))
    picked = rows.filter(ok).withColumn("_tree", F.explode(drawn))
    names = list(spec.by)
    id_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields) if names else ""
    prefix = id_fields + ", " if names else ""

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        pdf = pdf.sort_values(["_tree", "_v", "_draw"])
        pools = [pdf["_v"].to_numpy(dtype=float)[pdf["_tree"].to_numpy() == t] for t in range(trees)]
        pools = [p for p in pools if len(p)]
        m = min(sample, max(len(p) for p in pools))
        limit = int(np.ceil(np.log2(max(m, 2))))
        all_cuts, steps = [], []
        base = 0.0
        for values in pools:
            cuts, leaves = [], []
            _grow(np.sort(rng.choice(values, min(m, len(values)), replace=False)), 0, limit, rng, cuts, leaves)
            base += leaves[0]
            all_cuts.extend(cuts)
            steps.extend(np.diff(leaves))
        order = np.argsort(all_cuts, kind="stable")
        depth = base + np.concatenate([[0.0], np.cumsum(np.asarray(steps)[order])])
        norm = float(_average_path(m)) or 1.0
        score = np.power(2.0, -(depth / len(pools)) / norm)
        out = {n: [k] for n, k in zip(names, key)}
        out["_cuts"] = [np.asarray(all_cuts)[order].tolist()]
        out["_scores"] = [score.tolist()]
        return pd.DataFrame(out)

    forest = picked.select(*names, "_tree", "_draw", y.alias("_v"))
    keys = names or [F.lit(0).alias("_all")]
    forest = forest.groupBy(*keys).applyInPandas(
        (lambda key, pdf: grow(key, pdf)), schema=f"{prefix}_cuts array<double>, _scores array<double>"
    )
    # One copy of the step function per block of rows; rows choose a block by their draw.
    blocks = F.floor((F.col("_cnt") - 1) / F.lit(_ROWS_PER_TASK)) + 1
    scored_rows = rows.filter(ok).withColumn("_slot", F.floor(F.col("_draw") * blocks).cast("long"))
    per_series = series_join(forest, sizes, spec.by)
    copies = per_series.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", score double"
    columns = list(df.columns)
    target = spec.y

    def look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[columns].copy()
        at = np.searchsorted(np.asarray(right["_cuts"].iloc[0]), left[target].to_numpy(dtype=float), side="right")
        out["score"] = np.asarray(right["_scores"].iloc[0])[at]
        return out

    slot = [*names, "_slot"]
    scored = (
        scored_rows.select(*columns, "_slot").groupBy(*slot)
        .cogroup(copies.select(*names, "_slot", "_cuts", "_scores").groupBy(*slot))
        .applyInPandas(look_up, schema=schema)
    )
    scored = scored.unionByName(rows.filter(~ok).select(*columns).withColumn("score", F.lit(None).cast("double")))
    cut = exact_quantiles(scored, "score", [1.0 - contamination], spec.by, ["_cut"])
    out = attach(scored, cut, spec.by)
    return out.select(*columns, "score", _flag(F.col("score") > F.col("_cut")))


def flag_outliers(df: DataFrame, spec: SeriesSpec, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    if method == "iqr":
        return outlier_iqr(df, spec, threshold)
    if method == "zscore":
        return outlier_zscore(df, spec, threshold)
    if method == "isolation_forest":
        return outlier_isolation_forest(df, spec)
    raise ValueError(f"unknown outlier method {method!r}")


def outlier_remove(df: DataFrame, spec: SeriesSpec, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    return flag_outliers(df, spec, method, threshold).filter(~F.col(FLAG)).select(*df.columns)


def _replace(flagged: DataFrame, columns, y: str, value: Column) -> DataFrame:
    return flagged.select(*[F.when(F.col(FLAG), value).otherwise(F.col(c)).alias(c) if c == y else F.col(c) for c in columns])


def outlier_clip(df: DataFrame, spec: SeriesSpec, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Clip to the IQR bounds; other methods have no bounds and leave the rows alone."""
    if method != "iqr":
        return df
    flagged = outlier_iqr(df, spec, threshold)
    return _replace(flagged, df.columns, spec.y, F.greatest(F.col("lower"), F.least(F.col("upper"), F.col(spec.y))))


def outlier_median(df: DataFrame, spec: SeriesSpec, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    med = exact_quantiles(df, spec.y, [0.5], spec.by, ["_med"])
    flagged = attach(flag_outliers(df, spec, method, threshold), med, spec.by)
    return _replace(flagged, df.columns, spec.y, F.col("_med"))


def outlier_winsorize(df: DataFrame, spec: SeriesSpec, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Flagged values are clipped to the 5th and 95th percentile."""
    ends = exact_quantiles(df, spec.y, [0.05, 0.95], spec.by, ["_p5", "_p95"])
    flagged = attach(flag_outliers(df, spec, method, threshold), ends, spec.by)
    return _replace(flagged, df.columns, spec.y, F.greatest(F.col("_p5"), F.least(F.col("_p95"), F.col(spec.y))))


def treat_outliers(df: DataFrame, spec: SeriesSpec, method: str = "iqr", action: str = "remove",
                   threshold: float = 1.5) -> DataFrame:
    actions = {"remove": outlier_remove, "clip": outlier_clip, "median": outlier_median, "winsorize": outlier_winsorize}
    if action not in actions:
        raise ValueError(f"unknown outlier action {action!r}")
    return actions[action](df, spec, method, threshold)
