"""Unit-root and stationarity tests with all sums formed by Spark."""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from seriesloom.functions.linalg import least_squares, square, sum_arrays
from seriesloom.operators.index import BLK, BLOCK_ROWS, IDX, LEN, OWN, block_window, halo_blocks, order_series
from seriesloom.operators.joins import attach, keyed_join, series_join
from seriesloom.operators.profile import present
from seriesloom.operators.spectral import lag_products
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec

# Response surface of MacKinnon (1994) for a regression with constant.
ADF_MAX, ADF_MIN, ADF_SPLIT = 2.74, -18.83, -1.61
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
# Level table of Kwiatkowski, Phillips, Schmidt and Shin (1992).
KPSS_CRIT = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)
#: Lagged rows that a task holds at a time.
LAGGED_BYTES = 4 << 20


def adf_pvalue(stat: float) -> float:
    if stat > ADF_MAX:
        return 1.0
    if stat < ADF_MIN:
        return 0.0
    coef = ADF_SMALL if stat <= ADF_SPLIT else ADF_LARGE
    z = sum(c * stat**i for i, c in enumerate(coef))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def _unit_scaled(df: DataFrame, spec: SeriesSpec) -> tuple[DataFrame, SeriesSpec]:
    """Centre and scale the target of each series; the test statistics do not change by it."""
    rows = present(df, spec)
    y = F.col(spec.y).cast("double")
    stats = rows.groupBy(*spec.by).agg(F.avg(y).alias("_mu"), F.stddev_pop(y).alias("_sd"))
    z = (y - F.col("_mu")) / F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    out = attach(rows, stats, spec.by).select(*spec.by, spec.ts, *spec.tie, z.alias("_z"))
    return out, SeriesSpec(ts=spec.ts, y="_z", group=spec.group, tie=spec.tie)


def _block_grams(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per block the matrix of sums of its own rows (``gram``, a flat upper triangle) and their number ``n``.

    The lags are made inside the task, a run of rows at a time, so that one value per row is shuffled and sent to Python, however many lags a long series has.
    """
    schema = T.StructType([*[blocks.schema[c] for c in by], T.StructField("gram", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def sums(table: pa.Table) -> pa.Table:
        table = table.sort_by(IDX)
        at, own, y = (table[c].to_numpy() for c in (IDX, OWN, "_z"))
        limit = table["_L"][0].as_py()
        used = np.flatnonzero(own & (at > limit))
        total = np.zeros((limit + 3, limit + 3))
        if used.size:
            steps = sliding_window_view(np.diff(y), limit + 1)[:, ::-1]
            size = max(LAGGED_BYTES // total[0].nbytes, 1)
            for lo in range(used[0], used[-1] + 1, size):
                t = slice(lo - 1, min(lo + size, used[-1] + 1) - 1)
                z = np.column_stack([np.ones(t.stop - t.start), y[t], steps[t.start - limit : t.stop - limit]])
                total += z.T @ z
        one = 1 if used.size else 0
        made = [pa.array([total[np.triu_indices(limit + 3)]][:one], pa.list_(pa.float64())), pa.array([used.size][:one], pa.int64())]
        return pa.Table.from_arrays([*[table[c].slice(0, one) for c in by], *made], names=schema.names)

    return blocks.select(*by, BLK, IDX, OWN, "_L", "_z").groupBy(*by, BLK).applyInArrow(sums, schema)


def stationarity_adf(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Augmented Dickey-Fuller test with constant, lag order by AIC.

    The regressions for all lag orders share one matrix of sums per series. Series for
    which the test cannot be computed get (0, 1, false).
    """
    z, zspec = _unit_scaled(df, spec)
    rows = order_series(z, zspec).indexed()
    reach = F.least(F.ceil(12.0 * F.pow(F.col(LEN) / 100.0, 0.25)), F.floor(F.col(LEN) / 2) - 2)
    rows = rows.withColumn("_L", F.greatest(reach, F.lit(0)).cast("int"))
    sizes = rows.groupBy(*spec.by).agg(F.max(LEN).alias("n"), F.max("_L").alias("_L"))
    top = int(sizes.agg(F.coalesce(F.max("_L"), F.lit(0))).first()[0])
    blocks = halo_blocks(rows, back=top + 1)
    sums = sum_arrays(_block_grams(blocks, spec.by), spec.by, ["gram"], ["n"]).withColumnRenamed("n", "_rows")
    head = rows.filter(F.col(IDX) <= F.col("_L")).groupBy(*spec.by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(IDX, "_z"))), lambda s: s["_z"]).alias("_head")
    )
    table = series_join(series_join(sizes, sums, spec.by), head, spec.by)

    @F.pandas_udf("struct<stat double, p double, lags int>")
    def test(g: pd.Series, rows_n: pd.Series, lim: pd.Series, head_v: pd.Series) -> pd.DataFrame:
        out = []
        for flat, m, limit, first in zip(g, rows_n, lim, head_v):
            out.append(_adf_one(flat, m, int(limit), first))
        return pd.DataFrame(out, columns=["stat", "p", "lags"])

    res = table.select(*spec.by, "n", test("gram", "_rows", "_L", "_head").alias("_t"))
    return res.select(*spec.by, "n", F.col("_t.stat").alias("adf_stat"), F.col("_t.p").alias("adf_p"),
                      F.col("_t.lags").alias("adf_lags"), (F.col("_t.p") < 0.05).alias("adf_stationary"))


def _adf_one(flat, rows: float, limit: int, head) -> tuple[float, float, int]:
    failed = (0.0, 1.0, 0)
    if flat is None or rows is None or not np.isfinite(rows) or rows <= limit + 2:
        return failed
    g = square(flat)
    # Columns: constant, level, difference to explain, lagged differences.
    target = 2
    best = None
    for k in range(limit + 1):
        cols = [0, 1, *range(3, 3 + k)]
        _, rss, _ = least_squares(g, cols, target)
        if rss <= 1e-12 * rows:
            return failed
        aic = rows * (math.log(2 * math.pi) + math.log(rss / rows) + 1) + 2 * len(cols)
        if best is None or aic < best[0]:
            best = (aic, k)
    k = best[1]
    # The chosen regression may use the rows that longer lag orders could not.
    y = np.asarray(head, dtype=float)
    d = np.diff(y)
    extra = [[1.0, y[t - 1], *(d[t - 1 - i] for i in range(1, k + 1)), d[t - 1]] for t in range(k + 1, min(limit, len(y) - 1) + 1)]
    cols = [0, 1, *range(3, 3 + k), target]
    sub = g[np.ix_(cols, cols)]
    if extra:
        e = np.asarray(extra)
        sub = sub + e.T @ e
    m = rows + len(extra)
    beta, rss, inv = least_squares(sub, range(2 + k), 2 + k)
    dof = m - (2 + k)
    if dof <= 0 or rss <= 0:
        return failed
    stat = float(beta[1] / math.sqrt(rss / dof * inv[1, 1]))
    return stat, adf_pvalue(stat), k


def running_sum(indexed: DataFrame, spec: SeriesSpec, column: str, out: str = "_cum") -> DataFrame:
    """Cumulative sum of a column of ordered rows: totals of whole blocks, then sums inside a block."""
    rows = indexed.withColumn(BLK, F.floor(F.col(IDX) / F.lit(BLOCK_ROWS)).cast("long"))
    totals = rows.groupBy(*spec.by, BLK).agg(F.sum(column).alias("_tot"))
    key = spec.by or [F.lit(0)]
    run = W.partitionBy(*key).orderBy(BLK).rowsBetween(W.unboundedPreceding, 0)
    bases = totals.select(*spec.by, BLK, (F.sum("_tot").over(run) - F.col("_tot")).alias("_base"))
    inside = block_window(spec.by).rowsBetween(W.unboundedPreceding, 0)
    placed = keyed_join(rows, bases, [*spec.by, BLK], "inner")
    return placed.withColumn(out, F.col("_base") + F.sum(column).over(inside)).drop("_base", BLK)


def stationarity_kpss(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Level-stationarity test; bandwidth by Hobijn, Franses and Ooms (1998).

    The Bartlett-weighted long-run variance over l lags equals the mean square of sums over
    l + 1 neighbouring residuals, so it comes from differences of the running sum for any l.
    Series for which the test cannot be computed get (0, 1, true).
    """
    z, zspec = _unit_scaled(df, spec)
    rows = order_series(z, zspec).indexed().select(*spec.by, IDX, LEN, F.col("_z").alias("_c"))
    sizes = z.groupBy(*spec.by).agg(F.count(F.lit(1)).alias("n"))
    short = F.floor(F.pow(F.col("n").cast("double"), 2.0 / 9.0)).cast("int")
    top = int(sizes.agg(F.coalesce(F.max(short), F.lit(0))).first()[0])
    prods = materialize(lag_products(rows, spec, max(top, 1)))
    at = F.slice(F.col("products"), 2, F.greatest(short, F.lit(0)))
    half = F.col("n") / 2.0
    s0 = F.element_at("products", 1) / F.col("n") + F.aggregate(at, F.lit(0.0), lambda a, v: a + v / half)
    ranked = F.transform(at, lambda v, i: v * (i + 1))
    s1 = F.aggregate(ranked, F.lit(0.0), lambda a, v: a + v / half)
    gamma = 1.1447 * F.pow(F.pow(s1 / F.nullif(s0, F.lit(0.0)), 2), 1.0 / 3.0)
    lags = F.floor(gamma * F.pow(F.col("n").cast("double"), 1.0 / 3.0))
    bands = prods.select(*spec.by, "n", F.least(F.coalesce(lags, F.lit(0)), F.col("n") - 1).cast("long").alias("kpss_lags"))
    cum = running_sum(rows, spec, "_c").select(*spec.by, IDX, LEN, "_cum")
    cum = attach(cum, bands.drop("n"), spec.by)
    # Every row is sent to its own place and to the place l + 1 rows later; the two sides meet there.
    here = F.struct(F.col(IDX).alias("at"), F.col("_cum").alias("a"), F.lit(None).cast("double").alias("b"))
    later = F.struct((F.col(IDX) + F.col("kpss_lags") + 1).alias("at"), F.lit(None).cast("double").alias("a"), F.col("_cum").alias("b"))
    spread = cum.select(*spec.by, LEN, "kpss_lags", F.explode(F.array(here, later)).alias("_p"))
    met = spread.groupBy(*spec.by, F.col("_p.at").alias("_at")).agg(
        F.coalesce(F.max("_p.a"), F.lit(0.0)).alias("_a"), F.coalesce(F.max("_p.b"), F.lit(0.0)).alias("_b"),
        F.max(LEN).alias(LEN), F.max("kpss_lags").alias("kpss_lags"),
    )
    # Places beyond the end hold no residual, and the running sum has returned to zero there.
    diff = F.col("_a") - F.col("_b")
    n = F.max(LEN)
    stats = met.groupBy(*spec.by).agg(
        n.alias("n"), F.max("kpss_lags").alias("kpss_lags"),
        F.sum(F.when(F.col("_at") < F.col(LEN), F.col("_a") * F.col("_a"))).alias("_eta"),
        F.sum(F.when(F.col("_at") < F.col(LEN) + F.col("kpss_lags"), diff * diff)).alias("_win"),
    )
    lrv = F.col("_win") / (F.col("kpss_lags") + 1) / F.col("n")
    stat = F.col("_eta") / (F.col("n") * F.col("n")) / F.when(lrv > 1e-12, lrv)
    p = F.lit(KPSS_P[-1])
    for i in range(len(KPSS_CRIT) - 2, -1, -1):
        c0, c1, p0, p1 = KPSS_CRIT[i], KPSS_CRIT[i + 1], KPSS_P[i], KPSS_P[i + 1]
        p = F.when(F.col("kpss_stat") < c1, p0 + (F.col("kpss_stat") - c0) * ((p1 - p0) / (c1 - c0))).otherwise(p)
    p = F.when(F.col("kpss_stat") < KPSS_CRIT[0], KPSS_P[0]).otherwise(p)
    out = stats.select(*spec.by, "n", "kpss_lags", stat.alias("_s")).withColumn("kpss_stat", F.coalesce(F.col("_s"), F.lit(0.0)))
    out = out.withColumn("kpss_p", F.when(F.col("_s").isNull(), 1.0).otherwise(p))
    return out.select(*spec.by, "n", "kpss_stat", "kpss_p", "kpss_lags", (F.col("kpss_p") > 0.05).alias("kpss_stationary"))
