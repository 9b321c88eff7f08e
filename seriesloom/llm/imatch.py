"""I-Match fingerprints: distinct terms of a middle band of document frequency, hashed over randomised parts of the lexicon."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seriesloom.llm.words import mix, short_batches, text_slices, word_hashes
from seriesloom.operators.joins import keyed_join
from seriesloom.session import materialize


@dataclass(frozen=True)
class IMatchSettings:
    """The lexicon holds the terms found in at least 1/``rare`` of the rows (and in two at least) and at most 1/``common`` of the distinct texts.

    A document has a bounded number of distinct terms on average, so at most ``rare`` times that number of terms can be
    this frequent, whatever the number of documents: the lexicon has a bounded size. Level k of ``levels`` keeps each term with probability
    2**-(k + 1), in ``subsets`` independently drawn parts.

    Terms above the band are at most ``common`` times as many as a text has on average. They fill as many parts again, which count where less than
    1/``few`` of a document's known terms lie in the band, as with the near copies of a text that make up much of the table.
    """

    rare: int = 2000
    common: int = 20
    levels: int = 11
    subsets: int = 6
    few: int = 4


@dataclass(frozen=True)
class Lexicon:
    """Sorted hashes of the terms in the band and of those above it."""

    terms: np.ndarray
    common: np.ndarray


def document_frequencies(docs: DataFrame, text_col: str, copies_col: str) -> DataFrame:
    """(term, df, spare): in how many rows each word occurs, as a hash, and how many of them only repeat a text; tasks add up their own rows first.

    ``copies_col`` tells how many rows have the text of a row: each adds 1 - 1 / copies to the spare ones.
    """
    schema = T.StructType([T.StructField("term", T.LongType()), T.StructField("df", T.LongType()), T.StructField("spare", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spare = 1 - 1 / batch.column(1).to_numpy()
            for lo, hi, data, offsets in text_slices(batch.column(0), 2 << 20):
                h, first = word_hashes(data, offsets)
                own = [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                flat = np.concatenate(own)
                if flat.size:
                    term, at, df = np.unique(flat, return_inverse=True, return_counts=True)
                    more = np.bincount(at, np.repeat(spare[lo:hi], [x.size for x in own]), term.size)
                    yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df), pa.array(more)], names=schema.names)

    rows = short_batches(docs.select(text_col, copies_col)).mapInArrow(run, schema)
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.round(F.sum("spare")).cast("long").alias("spare"))


def lexicon(docs: DataFrame, text_col: str, settings: IMatchSettings = IMatchSettings()) -> Lexicon:
    """The terms in the band, and those above it.

    Copies of a text count once for the upper bound, so that they do not push their own terms out, and all for the lower one. Equal
    texts are told by a 64-bit hash.
    """
    keyed = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    repeated = materialize(keyed.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"))
    n = docs.count()
    distinct = n - (repeated.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    low, high = max(2, -(-n // settings.rare)), max(2, distinct // settings.common)
    counted = keyed_join(keyed, repeated, ["key"]).select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    rows = document_frequencies(counted, "text", "copies").where(F.col("df") >= low).select("term", (F.col("df") - F.col("spare") > high).alias("above")).toArrow()
    term, above = rows["term"].to_numpy().view(np.uint64), rows["above"].to_numpy()
    return Lexicon(np.sort(term[~above]), np.sort(term[above]))


def fingerprint_rows(data: np.ndarray, offsets: np.ndarray, words: Lexicon, s: IMatchSettings = IMatchSettings()) -> np.ndarray:
    """One 32-bit number per row and part of the lexicon: a hash of the row's sorted distinct terms in that part, 0 if it has none there.

    Parts of the terms in the band come first, then those of the terms above it.
    """
    h, first = word_hashes(data, offsets)
    return np.hstack([_parts(h, first, words.terms, s), _parts(h, first, words.common, s)])


def _parts(h: np.ndarray, first: np.ndarray, terms: np.ndarray, s: IMatchSettings) -> np.ndarray:
    if terms.size:
        at = np.minimum(np.searchsorted(terms, h), terms.size - 1)
        known = terms[at] == h
    else:
        known = np.zeros(h.size, bool)
    kept = np.concatenate([[0], np.cumsum(known)])[first]
    h = h[known]
    own = [np.unique(h[a:b]) for a, b in zip(kept[:-1].tolist(), kept[1:].tolist())]
    size = np.array([x.size for x in own])
    flat, row = np.concatenate([np.zeros(0, np.uint64), *own]), np.repeat(np.arange(size.size), size)
    out = np.zeros((size.size, s.levels * s.subsets), np.uint32)
    for k in range(s.levels):
        for j in range(s.subsets):
            part = k * s.subsets + j
            draw = mix(flat ^ np.uint64((part + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            chosen = np.flatnonzero(draw >> np.uint64(63 - k) == 0)
            if chosen.size:
                r = row[chosen]
                begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                total = np.add.reduceat(mix(draw[chosen]), begin)  # terms are distinct: a sum is as good as a sorted list
                out[r[begin], part] = (mix(total + np.uint64(1)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def as_text(rows: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Hex numbers of all parts; a row without a term in the lexicon is known by a hash of its text."""
    out = [r.tobytes().hex() for r in rows.astype(">u4")]
    for i in np.flatnonzero(~rows.any(axis=1)).tolist():
        out[i] = "t" + sha256(data[offsets[i] : offsets[i + 1]]).hexdigest()[:32]
    return out


def likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray, s: IMatchSettings = IMatchSettings()) -> np.ndarray:
    """Estimated share of common terms (0 to 1) of pairs of fingerprints.

    A part that keeps terms with probability r is equal for both if it holds none of the D terms in which they differ, and is empty for both
    if it holds none of all U terms; the likeliest D and U for the numbers of unequal and of non-empty parts give 1 - D / U. Terms in the band count;
    those above it count too if less than 1/``few`` of the known terms of either document lie in the band. Equal fingerprints
    give 1, those without an equal non-empty part 0. If neither has a term, the result is 1 where ``same`` (equal texts) and else 0.
    """
    grid = np.geomspace(0.25, 1 << (s.levels + 3), 160)
    none = np.log1p(-(0.5 ** np.arange(1, s.levels + 1)))[:, None] * grid  # log of the probability that a part holds none of them
    some = np.log(np.maximum(-np.expm1(none), 1e-300))

    def likeliest(parts: np.ndarray) -> np.ndarray:
        n = parts.reshape(len(parts), s.levels, s.subsets).sum(axis=2)
        return np.where(parts.any(axis=1), grid[np.argmax(n @ some + (s.subsets - n) @ none, axis=1)], 0)

    width = s.levels * s.subsets
    unequal, filled = a != b, (a > 0) | (b > 0)
    wide = np.zeros(len(a), bool)  # pairs for which terms above the band count
    for x in (a, b):
        inside, above = likeliest(x[:, :width] > 0), likeliest(x[:, width:] > 0)
        wide |= s.few * inside < inside + above
    differ, total = likeliest(unequal[:, :width]), likeliest(filled[:, :width])
    differ += np.where(wide, likeliest(unequal[:, width:]), 0)
    total += np.where(wide, likeliest(filled[:, width:]), 0)
    counts = np.arange(2 * width) < np.where(wide, 2 * width, width)[:, None]
    out = np.clip(1 - differ / np.maximum(total, grid[0]), 0, 1)
    out[~(filled & ~unequal & counts).any(axis=1)] = 0
    out[~(unequal & counts).any(axis=1)] = 1
    return np.where((filled & counts).any(axis=1), out, same.astype(float))


def fingerprints(docs: DataFrame, words: Lexicon, id_col: str = "doc_id", text_col: str = "text", settings: IMatchSettings = IMatchSettings()) -> DataFrame:
    """``id_col`` and ``fingerprint``, one row per input row; other columns are left out.

    NULL counts as the empty text. A text without a term of the lexicon is known by a hash of the text, so equal texts always have equal fingerprints.
    ``words`` comes from ``lexicon`` and has a bounded size. An empty table gives an empty one.
    """
    shared, s = docs.sparkSession.sparkContext.broadcast(words), settings
    docs = docs.select(id_col, text_col)
    schema = T.StructType([docs.schema[id_col], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), 1 << 20):
                text = as_text(fingerprint_rows(data, offsets, shared.value, s), data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(text, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many (or all) from the beginning of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def compare_edited(docs: DataFrame, words: Lexicon, id_col: str = "doc_id", text_col: str = "text", settings: IMatchSettings = IMatchSettings()) -> DataFrame:
    """Fingerprints of every text and of its edited text (``edited_text`` with the next document in ascending order of ids).

    Returns the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. Documents are dealt by id into ranges; each range also gets the first document of
    the next one, so texts are shuffled once and read in order. The last document is followed by the first. Rows of one id follow each other by a hash
    of their texts; NULL ids come first; NULL texts are empty; an empty table gives an empty one.
    """
    spark, s = docs.sparkSession, settings
    low = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("at", F.coalesce("id", F.lit(low)))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("at", [k / wanted for k in range(1, wanted)] or [0.5], 10 * wanted).alias("q")).first()["q"] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def part_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, at.to_numpy(), "right").astype(np.int32))

    dealt = rows.withColumn("part", part_of("at"))
    firsts = sorted(tuple(r) for r in rows.select("at").withColumn("part", part_of("at")).groupBy("part").agg(F.min("at")).collect())
    before = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]  # that of the first range goes to the last
    extra = spark.createDataFrame(before, "first long, to int")
    copies = dealt.join(F.broadcast(extra), F.col("at") == F.col("first")).select(F.col("to").alias("part"), F.lit(True).alias("copy"), "at", "id", "text")
    own = dealt.select("part", F.lit(False).alias("copy"), "at", "id", "text")
    ordered = own.union(copies).repartition(wanted, "part").sortWithinPartitions("part", "copy", "at", F.xxhash64("text")).select("part", "copy", "id", "text")
    shared = spark.sparkContext.broadcast(words)
    schema = T.StructType([
        T.StructField(id_col, T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def finish(held: list[tuple[int, str]], last: str) -> pa.RecordBatch:
        """Rows of consecutive documents; ``last`` follows them."""
        texts = [t for _, t in held] + [last]
        edited = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
        (_, _, data, offsets), = text_slices(pa.array(texts, pa.large_string()), 1 << 62)
        own = fingerprint_rows(data, offsets, shared.value, s)
        (_, _, d2, o2), = text_slices(pa.array(edited, pa.large_string()), 1 << 62)
        other = fingerprint_rows(d2, o2, shared.value, s)
        same = np.array([a == b for a, b in zip(texts, edited)]), np.array([a == b for a, b in zip(texts, texts[1:])])
        columns = [
            [i for i, _ in held], [len(t) for t in texts[:-1]], [sha256(d2[a:b]).hexdigest() for a, b in zip(o2[:-1].tolist(), o2[1:].tolist())],
            as_text(own[:-1], data, offsets), as_text(other, d2, o2), likeness(own[:-1], other, same[0]), likeness(own[:-1], own[1:], same[1]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at, closed = [], 0, None, False
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                for part, copy, i, text in zip(*(c.to_pylist() for c in piece.columns)):
                    if part != at:
                        held, size, at, closed = [], 0, part, False
                    if closed:
                        continue  # a repeated row of the first id of the next range
                    if copy:
                        if held:
                            yield finish(held, text)
                        held, closed = [], True
                        continue
                    if size > 1 << 20:
                        yield finish(held, text)
                        held, size = [], 0
                    held.append((i, text))
                    size += len(text)

    return ordered.mapInArrow(run, schema)
