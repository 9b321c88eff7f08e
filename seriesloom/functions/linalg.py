"""Normal equations as distributed sums, and small solves on the reduced rows."""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _same(a: Sequence, b: Sequence) -> bool:
    """Whether two series keys are equal; missing parts are equal to each other."""
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def _runs(batches: Iterator[pd.DataFrame], by: Sequence[str], reduce: Callable[[pd.DataFrame], tuple], columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Sum what ``reduce`` makes of the rows of each series. Rows come sorted by series; the last series of a batch stays open for the next."""
    key, total = None, None
    for pdf in batches:
        done = []
        for k, part in (pdf.groupby(list(by), dropna=False, sort=False) if by else [((), pdf)]) if len(pdf) else ():
            made = reduce(part)
            if total is not None and _same(k, key):
                total = tuple(a + b for a, b in zip(total, made))
                continue
            if total is not None:
                done.append([*key, *total])
            key, total = k, made
        if done:
            yield pd.DataFrame(done, columns=[*by, *columns], dtype=object)
    if total is not None:
        yield pd.DataFrame([[*key, *total]], columns=[*by, *columns], dtype=object)


def sum_arrays(partials: DataFrame, by: Sequence[str], arrays: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """Per series the sums of its arrays, place by place, and of its counts. A task reads the arrays one by one and holds one sum; a series has one array per task that met it."""
    by, arrays, counts = list(by), list(arrays), list(counts)
    columns = [*arrays, *counts]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _runs(batches, by, lambda part: tuple([np.sum(np.stack(part[a].to_list()), axis=0) for a in arrays] + [int(part[c].sum()) for c in counts]), columns)

    near = partials.select(*by, *columns)
    near = near.repartition(*by).sortWithinPartitions(*by) if by else near.repartition(1)
    return near.mapInPandas(merge, near.schema)


def gram(df: DataFrame, by: Sequence[str], inputs: Sequence[str],
         design: Callable[[pd.DataFrame], np.ndarray] | None = None, width: str | None = None) -> DataFrame:
    """Per series the matrix Z'Z of the design rows, as its flat upper triangle ``gram``, and the row count ``n``.

    Rows are sorted by series inside their tasks, so a task gives one array per series that it
    meets, whatever the number of rows and of Arrow batches; the shuffle carries only those.
    ``design`` turns a batch into its matrix, by default the input columns themselves.
    ``width`` names a column with the number of leading columns that a series needs, so
    that short series do not carry the matrix of the longest one.
    """
    by, inputs = list(by), list(inputs)
    picked = df.select(*by, *inputs, *([width] if width else []))
    ids = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields]
    schema = ", ".join([*ids, "gram array<double>", "n bigint"])

    def product(part: pd.DataFrame) -> tuple:
        z = design(part) if design else part[inputs].to_numpy(dtype=float)
        if width:
            z = z[:, : int(part[width].iloc[0])]
        return (z.T @ z)[np.triu_indices(z.shape[1])], len(part)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _runs(batches, by, product, ["gram", "n"])

    near = picked.sortWithinPartitions(*by) if by else picked
    return sum_arrays(near.mapInPandas(partial, schema), by, ["gram"], ["n"])


def least_squares(g: np.ndarray, cols: Sequence[int], target: int, ridge: np.ndarray | None = None):
    """Coefficients, residual sum of squares and (X'X)^-1 from a matrix of sums."""
    cols = list(cols)
    xtx = g[np.ix_(cols, cols)].copy()
    xty = g[cols, target]
    raw = xtx.copy()
    if ridge is not None:
        xtx[np.diag_indices_from(xtx)] += ridge
    scale = np.sqrt(np.maximum(np.diag(xtx), 1e-300))
    inv = np.linalg.pinv(xtx / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    beta = inv @ xty
    rss = float(g[target, target] - 2 * beta @ xty + beta @ raw @ beta)
    return beta, max(rss, 0.0), inv


def square(flat: Sequence[float]) -> np.ndarray:
    """The symmetric matrix of a flat upper triangle."""
    v = np.asarray(flat, dtype=float)
    k = int(round((np.sqrt(8 * len(v) + 1) - 1) / 2))
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = v
    return out + np.triu(out, 1).T
