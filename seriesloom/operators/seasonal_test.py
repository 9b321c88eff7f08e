"""Is a seasonal pattern stable? The test of Canova and Hansen (1995), with all sums formed by Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from seriesloom.functions.linalg import sum_arrays
from seriesloom.operators.index import BLK, IDX, LEN, OWN, halo_blocks, indexed_rows
from seriesloom.operators.profile import present
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec

# 5 percent points of the joint test by period; other periods follow CH_SCALE * period ** CH_POWER.
CH_CRITICAL = {
    2: 0.4617146, 3: 0.7479655, 4: 1.0007818, 5: 1.2375350, 6: 1.4625240, 7: 1.6920200, 8: 1.9043096, 9: 2.1169602, 10: 2.3268562,
    11: 2.5406922, 12: 2.7391007, 24: 5.098624, 52: 10.341416, 365: 65.44445,
}
CH_SCALE, CH_POWER = 0.269, 0.928
#: Numbers that a task holds for the running sums of a block.
BLOCK_CELLS = 1 << 21


def ch_critical(period: int) -> float:
    return CH_CRITICAL.get(period, CH_SCALE * period**CH_POWER)


def bandwidth(period: int, n: int) -> int:
    return int(round(period * (n / 100.0) ** 0.25))


def seasonal_stability(df: DataFrame, spec: SeriesSpec, period: int) -> DataFrame:
    """n, ch_stat, ch_critical, seasonal_d (1: the pattern drifts, so seasonal differences are due).

    Residuals are deviations from the mean of their season (row position modulo ``period``). The statistic compares the running sums of residuals by season with
    the long-run covariance of the residuals by season, over all seasonal frequencies. A series is cut into blocks of whole seasons; a block knows the sums of earlier ones from one
    row of totals per block, so a series of any length is spread over tasks. Rows without a value are left out. Series with 2 * ``period`` + 5 rows or fewer,
    a perfectly regular pattern or ``period`` below 2 get (0, 0).
    """
    m, by = int(period), spec.by
    y = F.col(spec.y).cast("double")
    critical = F.lit(ch_critical(max(m, 2)))
    if m < 2:
        return present(df, spec).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, "n", F.lit(0.0).alias("ch_stat"), critical.alias("ch_critical"), F.lit(0).alias("seasonal_d"))
    rows = indexed_rows(present(df, spec), spec).select(*by, IDX, LEN, y.alias("_y"))
    longest = rows.agg(F.coalesce(F.max(LEN), F.lit(1))).first()[0]
    back = min(bandwidth(m, longest), longest)
    size = max(m, back, BLOCK_CELLS // m) // m * m + (m if back > BLOCK_CELLS // m else 0)

    # Totals by block and season, then the mean of each season and what precedes each block.
    season = F.pmod(F.col(IDX), F.lit(m))
    placed = rows.withColumn(BLK, F.floor(F.col(IDX) / size).cast("long"))
    sums = placed.groupBy(*by, BLK).agg(
        F.max(LEN).alias("_n"), F.array(*[F.coalesce(F.sum(F.when(season == s, F.col("_y"))), F.lit(0.0)) for s in range(m)]).alias("_b")
    )
    sums = materialize(sums)
    whole = W.partitionBy(*(by or [F.lit(0)]))
    before = whole.orderBy(BLK).rowsBetween(W.unboundedPreceding, -1)
    total = [F.sum(F.col("_b")[s]).over(whole) / F.greatest(F.floor((F.col("_n") - 1 - s) / m) + 1, F.lit(1)) for s in range(m)]
    earlier = [F.coalesce(F.sum(F.col("_b")[s]).over(before), F.lit(0.0)) for s in range(m)]
    info = sums.select(*by, BLK, "_n", F.array(*total).alias("_mean"), F.array(*earlier).alias("_prior"))

    blocks = halo_blocks(rows, back=back, block=size).select(*by, BLK, IDX, OWN, "_y")
    keys = [*by, BLK]
    ids = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields]

    def parts(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        one = right.iloc[0]
        n, mean, prior, blk = int(one["_n"]), np.asarray(one["_mean"], float), np.asarray(one["_prior"], float), int(one[BLK])
        left = left.sort_values(IDX)
        at, own, e = left[IDX].to_numpy(), left[OWN].to_numpy(bool), left["_y"].to_numpy(float)
        place = at % m
        e = e - mean[place]
        first = int(np.argmax(own))
        steps = np.zeros((own.sum(), m))
        steps[np.arange(len(steps)), place[first:]] = e[first:]
        run = prior - blk * (size // m) * mean + np.cumsum(steps, axis=0)
        cover, width = np.zeros((m, m)), bandwidth(m, n)
        for k in range(min(width, len(e) - 1) + 1):
            lo = max(first, k)
            if lo >= len(e):
                break
            c = np.bincount(place[lo:], e[lo:] * e[lo - k : len(e) - k], m) * (1 - k / (width + 1))
            s = np.arange(m)
            cover[s, (s - k) % m] += c
            if k:
                cover[(s - k) % m, s] += c
        out = {c: [one[c]] for c in by}
        return pd.DataFrame({**out, "_S": [(run.T @ run).ravel()], "_O": [cover.ravel()], "_q": [[float(e[first:] @ e[first:]), float(((e[first:] + mean[place[first:]]) ** 2).sum())]], "n": [len(steps)]})

    schema = ", ".join([*ids, "_S array<double>", "_O array<double>", "_q array<double>", "n bigint"])
    pieces = blocks.groupBy(*keys).cogroup(info.groupBy(*keys)).applyInPandas(parts, schema)
    summed = sum_arrays(pieces, by, ["_S", "_O", "_q"], ["n"])

    @F.pandas_udf("double")
    def statistic(s: pd.Series, o: pd.Series, q: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([joint_statistic(*x, m) for x in zip(s, o, q, n)], dtype=float)

    out = summed.select(*by, "n", statistic("_S", "_O", "_q", "n").alias("ch_stat"), critical.alias("ch_critical"))
    return out.withColumn("seasonal_d", (F.col("ch_stat") > F.col("ch_critical")).cast("int"))


def joint_statistic(s, o, q, n: int, m: int) -> float:
    """n^-2 tr(O^-1 S) on the space of seasonal contrasts, whichever basis it has."""
    if n <= 2 * m + 5 or q[0] <= 1e-12 * max(q[1], 1e-300):
        return 0.0
    contrast = np.linalg.qr(np.hstack([np.ones((m, 1)), np.eye(m)[:, 1:]]))[0][:, 1:]
    s, o = (contrast.T @ np.asarray(x, float).reshape(m, m) @ contrast for x in (s, o))
    return float(np.trace(np.linalg.pinv(o / n, hermitian=True) @ s) / n**2)


def seasonal_order(df: DataFrame, spec: SeriesSpec, period: int) -> DataFrame:
    """The seasonal difference order (0 or 1) of each series, as ``sd``."""
    return materialize(seasonal_stability(df, spec, period).select(*spec.by, F.col("seasonal_d").alias("sd")))
