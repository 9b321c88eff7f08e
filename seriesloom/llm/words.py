"""Words and shingles of whole batches of texts as numpy arrays, for use inside Arrow tasks.

Texts are looked at as UTF-8 bytes. A word is a run of bytes other than space, tab and the line breaks 0x0A-0x0D; A-Z may be
lower-cased. Words and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (in place on a fresh array)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers[0].size >= n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= (2 << 20) + 4096:  # tables for a single very long text are not kept
        _powers[:] = made
    return made[0], made[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every span, from one running sum over ``data``."""
    up, down = _power_tables(data.size + 1)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: data.size], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Let Arrow batches of this session hold at most ``rows`` rows: texts are long, and a batch is held by the JVM and by Python at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


@contextmanager
def batch_bytes(spark: SparkSession, size: int = 4 << 20, rows: int = 512) -> Iterator[None]:
    """Within this block, jobs send Arrow batches of at most ``size`` bytes (a longer row makes one of its own) and read Parquet by ``rows`` rows; the session's own limits return after it."""
    limits = {"spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.parquet.columnarReaderBatchSize": rows}
    before = {key: spark.conf.get(key) for key in limits}
    for key, value in limits.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def text_slices(column: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of rows of about ``max_bytes``: first row, end row, bytes, offsets.

    NULL counts as empty. A longer text makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each row's words begin (one more entry than rows)."""
    if not data.size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(offsets.size, np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(data.size + 1, bool)
    cut[offsets] = True
    before = np.empty(data.size, bool)
    before[0], before[1:] = True, ~inside[:-1]
    after = np.empty(data.size, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (before | cut[:-1]))
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each row's words begin."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For every row the sorted distinct hashes of its runs of ``size`` words (a shorter row: its whole sequence as one)."""
    words, first = word_hashes(data, offsets)
    steps = mix(np.arange(11, 11 + size, dtype=np.uint64)) | np.uint64(1)
    runs = np.zeros(max(words.size - size + 1, 0), np.uint64)
    for k in range(size):
        runs += words[k : k + runs.size] * steps[k]
    runs = mix(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            h = (words[a:b] * steps[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
