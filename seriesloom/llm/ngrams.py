"""Hashed character n-grams of whole batches of texts, and their use in linear scores."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from seriesloom.llm.words import short_batches, text_slices

_STEP = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """Which code points are letters."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def lowered() -> np.ndarray:
    """Lower-case form of every code point that has one of a single code point."""
    if "lowered" not in _tables:
        t = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(letters()).tolist():
            low = chr(c).lower()
            if len(low) == 1:
                t[c] = ord(low)
        _tables["lowered"] = t
    return _tables["lowered"]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the rows' offsets among them."""
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    if cps.size == data.size:
        return cps, offsets
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return cps, lead[offsets]


def ngrams(cps: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams that stay inside a row, where each row's n-grams begin, and how many it has."""
    size = np.maximum(np.diff(offsets) - (n - 1), 0)
    h = np.full(max(cps.size - n + 1, 0), n, np.uint64)
    for k in range(n):
        h = (h ^ cps[k : k + h.size]) * _STEP
    h = (h >> np.uint64(64 - bits)).astype(np.int64)
    if n > 1 and size.sum() != h.size:
        keep = np.ones(h.size, bool)
        for k in range(1, n):
            ends = offsets[1:] - k
            keep[ends[(ends >= 0) & (ends < h.size)]] = False
        h = h[keep]
    begin = np.concatenate([[0], np.cumsum(size)])
    return h[: begin[-1]], begin[:-1], size


def row_sums(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of each row's consecutive values; 0 for empty rows."""
    out = np.zeros((size.size, *values.shape[1:]), np.float64)
    full = np.flatnonzero(size)
    if full.size:
        out[full] = np.add.reduceat(values, begin[full], axis=0)
    return out


def row_counts(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their counts) of every row over several kinds of features."""
    rows = []
    for k in range(parts[0][2].size):
        rows.append(np.unique(np.concatenate([h[b[k] : b[k] + s[k]] for h, b, s in parts]), return_counts=True))
    return rows


class Sparse:
    """Rows of (feature, value) as one array each."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.feature = np.concatenate([f for f, _ in rows]) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]).astype(np.float64) if rows else np.zeros(0)
        self.begin = np.concatenate([[0], np.cumsum([len(f) for f, _ in rows])]).astype(np.int64)

    def take(self, rows: np.ndarray) -> "Sparse":
        return Sparse([(self.feature[self.begin[r] : self.begin[r + 1]], self.value[self.begin[r] : self.begin[r + 1]]) for r in rows.tolist()])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return row_sums(weights[self.feature] * self.value[:, None], self.begin[:-1], np.diff(self.begin))

    def t_dot(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Sum over rows of value * rows[row], per feature."""
        back = np.repeat(np.arange(self.begin.size - 1), np.diff(self.begin))
        return np.stack([np.bincount(self.feature, self.value * rows[back, c], size) for c in range(rows.shape[1])], axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score_texts(docs: DataFrame, text_col: str, fields: list[T.StructField], score: Callable) -> DataFrame:
    """Add columns that ``score(bytes, offsets)`` makes of slices of ``text_col``; the text itself is left out, NULL counts as empty."""
    kept = [c for c in docs.columns if c != text_col]
    docs = short_batches(docs.select(*kept, text_col))
    schema = T.StructType([docs.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(len(kept)), 1 << 20):
                made = score(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(lo, hi - lo) for k in range(len(kept))] + [pa.array(x) for x in made], names=schema.names)

    return docs.mapInArrow(run, schema)


def train_in_task(sample: DataFrame, fit: Callable[[list[dict]], bytes]) -> bytes:
    """Run ``fit`` on the rows of a bounded sample in one task; the model comes to the driver as bytes. ``fit`` may get no rows at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows)], pa.binary())], names=["model"])

    row = short_batches(sample).repartition(1).mapInArrow(run, "model binary").first()
    return bytes(row["model"]) if row else fit([])  # a plan known to be empty runs no task
