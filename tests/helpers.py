"""Small series with the awkward shapes that operators must survive."""

import datetime as dt

import numpy as np
import pandas as pd

from seriesloom.spec import SeriesSpec

SPEC = SeriesSpec(group="grp", tie="id")
T0 = dt.datetime(2023, 1, 1)
SCHEMA = "grp string, ts timestamp_ntz, y double, id bigint"


def series(spark, groups: dict, step=dt.timedelta(days=1)):
    """A table with one row per value; None is a missing value."""
    rows, k = [], 0
    for g, values in groups.items():
        for i, v in enumerate(values):
            rows.append((g, T0 + i * step, None if v is None else float(v), k))
            k += 1
    # Out of order, so that operators have to sort.
    rng = np.random.default_rng(1)
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def noise(n, seed=0, ar=0.0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n)
    out = np.zeros(n)
    for i in range(n):
        out[i] = (ar * out[i - 1] if i else 0.0) + e[i]
    return out


def skewed():
    """One series holds most of the rows; others are short, constant, single or all missing."""
    big = [None if i % 11 == 3 else v for i, v in enumerate(10 + noise(160, 3))]
    gaps = [None, None, 1.0, None, None, 4.0, None]
    return {"big": big, "gaps": gaps, "const": [5.0] * 9, "one": [7.0], "none": [None] * 4}


def by_group(df, *columns):
    pdf = df.toPandas().sort_values(["grp", "ts", "id"] if "id" in df.columns else ["grp", "ts"])
    return {g: p[list(columns)].to_numpy(dtype=float) for g, p in pdf.groupby("grp")}


def pandas_series(groups):
    return {g: pd.Series([np.nan if v is None else float(v) for v in vs]) for g, vs in groups.items()}
