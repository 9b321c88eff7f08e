"""Line deduplication within an edit distance of one, by a join of deletion neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seriesloom.llm.ngrams import code_points
from seriesloom.llm.words import _BASE, _BASE_INVERSE, _power_tables, mix, short_batches, text_slices
from seriesloom.operators.joins import keyed_join
from seriesloom.session import materialize


@dataclass(frozen=True)
class LineSettings:
    """``near_chars``: shorter lines are compared exactly only.

    Lines within one edit share all but one piece of any cut. Cut in two this tells which lines may have a neighbour, cut in ``pieces`` it tells where the edit lies.
    """

    near_chars: int = 16
    pieces: int = 8


_BLANK = np.zeros(1 << 16, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CODES = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
_u = np.uint64


class Lines:
    """Lines of a slice of texts, without white space at their ends, and hashes of any part of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        cps, at = code_points(data, offsets)
        low = np.minimum(cps, 0xFFFF)
        breaks = np.flatnonzero(cps == 10)
        rows = np.repeat(np.arange(at.size - 1), np.diff(np.searchsorted(breaks, at)))  # row of each break
        start = np.concatenate([at[:-1], breaks + 1])
        row = np.concatenate([np.arange(at.size - 1), rows])
        order = np.lexsort((start, row))
        self.row, start = row[order], start[order]
        first = np.searchsorted(self.row, np.arange(at.size - 1))
        self.number = np.arange(row.size) - first[self.row]
        stop = np.append(start[1:] - 1, 0)
        last = np.append(first[1:], row.size) - 1
        stop[last] = at[1:]
        ink = np.flatnonzero(~_BLANK[low])
        a, b = np.searchsorted(ink, start), np.searchsorted(ink, stop)
        full = b > a
        self.start, self.size = start.copy(), np.zeros(row.size, np.int64)
        self.start[full] = ink[a[full]]
        self.size[full] = ink[b[full] - 1] + 1 - self.start[full]
        codes = _CODES[low]
        wide = np.flatnonzero(cps > 0xFFFE)
        codes[wide] = mix(cps[wide].astype(np.uint64) + _u(1))
        self.up, self.down = _power_tables(cps.size + 2)
        self.sums = np.zeros(cps.size + 1, np.uint64)
        np.cumsum(codes * self.up[: cps.size], out=self.sums[1:])

    def part(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Polynomial hash of [start, stop), the same wherever the part stands."""
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def piece_keys(self, which: np.ndarray, pieces: int, short: int) -> np.ndarray:
        """For every line the hashes of all but one piece, per left-out piece, as a line of ``size - short`` characters is cut."""
        start, size = self.start[which], self.size[which]
        base = size - short
        out = np.empty((which.size, pieces), np.uint64)
        for q in range(pieces):
            left, right = base * q // pieces, base * (q + 1) // pieces
            a = self.part(start, start + left)
            b = self.part(start + size - (base - right), start + size)
            out[:, q] = mix(mix(a ^ base.astype(np.uint64) * _u(pieces + 1) + _u(q)) + b)
        return out


def _column(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _line_table(docs: DataFrame, s: LineSettings) -> DataFrame:
    """(id, line, h1, h2, keys) of every line with ink; keys are NULL for lines that are compared exactly only."""
    schema = T.StructType([docs.schema["id"], T.StructField("line", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), 1 << 20):
                x = Lines(data, offsets)
                which = np.flatnonzero(x.size)
                raw = x.part(x.start[which], x.start[which] + x.size[which]) + x.size[which].astype(np.uint64)
                near = np.flatnonzero(x.size[which] >= s.near_chars)
                keys = np.concatenate([x.piece_keys(which[near], 2, short) for short in (0, 1)], axis=1)
                length = np.zeros(which.size, np.int32)
                length[near] = 4
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), _column(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(x.row[which])), pa.array(x.number[which]), _column(mix(raw ^ _u(0x51ED270B))), _column(mix(raw + _u(0x3C6EF372FE94F82B))), column], names=schema.names
                )

    return docs.mapInArrow(run, schema)


def _variants(held: DataFrame, s: LineSettings) -> DataFrame:
    """Deletion neighbourhoods of lines (id, line, text, open): (key, role, id, line).

    Bit q of ``open`` says that the line shares all but piece q with another one if cut at its own length, bit pieces + q that it does if cut as a line one shorter. The edit then lies
    in that piece, so only its deletions are emitted. A substitution is a deletion at one and the same place of both (role 0); a
    deletion makes the longer line (role 2) equal to the whole shorter one (role 1).
    """
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("role", T.IntegerType()), held.schema["id"], held.schema["line"]])
    n = s.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2), 1 << 18):
                cps, at = code_points(data, offsets)
                ids, lines = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                opened = batch.column(3).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                codes = np.where(cps > 0xFFFE, mix(cps.astype(np.uint64) + _u(1)), _CODES[np.minimum(cps, 0xFFFF)])
                up, down = _power_tables(cps.size + 2)
                sums = np.zeros(cps.size + 1, np.uint64)
                np.cumsum(codes * up[: cps.size], out=sums[1:])
                start, size = at[:-1], np.diff(at)
                whole = (sums[at[1:]] - sums[start]) * down[start]
                out = []
                for q in range(n):
                    own = np.flatnonzero(opened >> q & 1)
                    if own.size:
                        a, b = size[own] * q // n, size[own] * (q + 1) // n
                        out.append((own, mix(whole[own] + _u(q)), np.ones(own.size, np.int32)))
                        out.append(_deletions(sums, down, start, size, own, a, b, q, 0))
                    longer = np.flatnonzero(opened >> (n + q) & 1)
                    if longer.size:
                        a, b = (size[longer] - 1) * q // n, (size[longer] - 1) * (q + 1) // n + 1
                        out.append(_deletions(sums, down, start, size, longer, a, b, q, 2))
                if out:
                    who = pa.array(np.concatenate([w for w, _, _ in out]))
                    yield pa.RecordBatch.from_arrays([_column(np.concatenate([k for _, k, _ in out])), pa.array(np.concatenate([r for _, _, r in out])), ids.take(who), lines.take(who)], names=schema.names)

    return held.mapInArrow(run, schema)


def _deletions(sums, down, start, size, which, a, b, q, role):
    """Hashes of the lines ``which`` without the character i, for all a <= i < b."""
    n = b - a
    who = np.repeat(which, n)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    s, e = start[who], start[who] + size[who]
    raw = (sums[s + i] - sums[s]) * down[s] + (sums[e] - sums[s + i + 1]) * down[s] * _u(_BASE_INVERSE)
    if role == 0:
        raw = mix(raw + i.astype(np.uint64) * _u(_BASE)) ^ _u(0x2545F4914F6CDD1D)
    return who, mix(raw + _u(q)), np.full(who.size, role, np.int32)


def _pick_lines(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, line, text) of the lines that ``asked`` (id, wanted: array of line numbers) names."""
    rows = keyed_join(docs, asked, ["id"], "inner").select("id", "text", "wanted")
    schema = T.StructType([docs.schema["id"], T.StructField("line", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                found = []
                for i, text, lines in zip(*(c.slice(lo, 256).to_pylist() for c in batch.columns)):
                    parts = (text or "").split("\n")
                    found += [(i, k, parts[k].strip(" \t\v\f\r")) for k in lines if k < len(parts)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((batch.column(0).type, pa.int64(), pa.string()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _fine_keys(held: DataFrame, s: LineSettings) -> DataFrame:
    """(id, line, slot, key): what every line holds but for one of its pieces, cut at its own length (slot q) and as a line one shorter (slot pieces + q)."""
    schema = T.StructType([held.schema["id"], held.schema["line"], T.StructField("slot", T.IntegerType()), T.StructField("key", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2), 1 << 20):
                x = Lines(data, offsets)
                keys = np.concatenate([x.piece_keys(np.arange(hi - lo), s.pieces, short) for short in (0, 1)], axis=1)
                who = pa.array(np.repeat(np.arange(hi - lo), 2 * s.pieces))
                slot = pa.array(np.tile(np.arange(2 * s.pieces, dtype=np.int32), hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(who), batch.column(1).slice(lo, hi - lo).take(who), slot, _column(keys.reshape(-1))], names=schema.names)

    return held.mapInArrow(run, schema)


def repeated_lines(docs: DataFrame, settings: LineSettings = LineSettings()) -> DataFrame:
    """(id, line) of all lines that repeat an earlier one, exactly or within one edit. ``docs`` holds id and text."""
    s = settings
    lines = materialize(_line_table(docs.where("id IS NOT NULL AND text IS NOT NULL"), s))
    at = F.struct("id", "line")
    # Equal lines are one class from here on; its first line stands for it.
    classes = materialize(lines.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.first("keys", ignorenulls=True).alias("keys")))
    keyed = classes.where("keys IS NOT NULL").select("h1", F.col("first.id").alias("id"), F.col("first.line").alias("line"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    asked = keyed.select("id", "line", "key").join(shared, "key").groupBy("id").agg(F.collect_set("line").alias("wanted"))
    held = materialize(_pick_lines(docs, asked).dropDuplicates(["id", "line"]))
    fine = materialize(_fine_keys(held, s))
    shared = fine.groupBy("key").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select("key")
    opened = fine.join(shared, "key").groupBy("id", "line").agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("open"))
    variants = materialize(_variants(held.join(opened, ["id", "line"]).select("id", "line", "text", "open"), s))
    least = variants.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, at)).alias(f"r{r}") for r in range(3)])
    least = least.where("r0 IS NOT NULL OR (r1 IS NOT NULL AND r2 IS NOT NULL)")
    partner = F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1"))
    found = variants.join(least, "key").withColumn("other", partner).where(F.col("other") < at).groupBy("id", "line").agg(F.min("other").alias("other"))
    mine = held.select("id", "line", F.col("text").alias("mine"))
    theirs = held.select(F.col("id").alias("oid"), F.col("line").alias("oline"), F.col("text").alias("theirs"))
    near = found.select("id", "line", F.col("other.id").alias("oid"), F.col("other.line").alias("oline")).join(mine, ["id", "line"]).join(theirs, ["oid", "oline"])
    near = near.where(F.levenshtein("mine", "theirs", 1).between(0, 1)).select(at.alias("first"), F.lit(True).alias("near"))
    marked = classes.select("h1", "h2", "first").join(near, "first", "left")
    return lines.select("id", "line", "h1", "h2").join(marked, ["h1", "h2"]).where(F.col("near").isNotNull() | (F.col("first") != at)).select("id", "line")


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: LineSettings = LineSettings()) -> DataFrame:
    """All columns with repeated lines taken out of the text, and n_lines and n_removed (of any of these names, columns of the input are replaced).

    Lines are compared without white space at their ends; blank ones stay. A line goes if an earlier one, by id and place in the text, equals it, or, from
    ``near_chars`` characters on, lies within one edit of it (insertion, deletion or substitution of a code point), whether that one stays or
    not. Rows of one id count as one document. Rows with a NULL id or text stay as they are, with 0 lines for NULL texts. Long texts are read whole.

    Equal lines meet in a pre-aggregated minimum, and so do equal deletion variants: all lines of a group of substitutions at one place are
    within one edit of each other, so the earliest is all that is needed and no pairs are formed. What is to be looked up or removed per document is
    broadcast while its measured size is small, and joined by a shuffle beyond that.
    """
    rows = short_batches(docs.drop("n_lines", "n_removed"))
    gone = repeated_lines(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), settings)
    gone = gone.distinct().groupBy(F.col("id").alias("_gone_id")).agg(F.collect_list(F.col("line").cast("int")).alias("_gone"))
    joined = keyed_join(rows.withColumn("_gone_id", F.col(id_col)), gone, ["_gone_id"]).drop("_gone_id")
    parts = F.split(F.col(text_col), "\n", -1)
    # Numbers of the lines that stay, by a hash set; the outer transform makes the lines once for all of them.
    stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    kept = F.transform(F.array(parts), lambda p: F.array_join(F.transform(stays, lambda k: F.get(p, k)), "\n"))[0]
    return joined.select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in rows.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
