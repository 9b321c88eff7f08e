"""Ranked lexical search over a length-stratified index.

Documents with the same length normaliser m form a stratum. In a stratum the postings of a term are runs of equal frequency tf, so that an impact,
which depends on m and tf alone, is computed once per run. The largest tf of a term bounds what the term can add in the stratum, and the sum over an
item's terms bounds every score there: strata are visited by descending bound, and the visit ends once the bound is below the k-th best score.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, log
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from seriesloom.llm.words import batch_bytes, span_hashes, text_slices, word_spans
from seriesloom.session import materialize

#: Bytes of terms as they are, with A-Z lowered; every other byte becomes a blank. Code points from 128 on consist of bytes from 128 on.
_TERM = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM[_low:_high] = np.arange(_low, _high)
_TERM[0x41:0x5B] += 32

#: A cell is megabytes long: every one is a page of its own, few share a row group, and none is kept as a bound, so that neither writer nor reader holds many at once.
_CELL_TABLE = {"parquet.page.row.count.limit": "1", "parquet.block.row.count.limit": "8", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}


@dataclass(frozen=True)
class RankSettings:
    """``base`` and ``slope`` make the normaliser m = 100 - slope + (slope * n * N) div L; ``saturation`` weighs it against tf.
    A cell of the index has about ``cell_postings`` postings; items are taken in blocks of about ``block_chars`` characters."""

    slope: int = 50
    saturation: int = 20
    cell_postings: int = 1 << 17
    block_chars: int = 4_000_000


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term, and where each row's terms begin."""
    data = _TERM[data]
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends).view(np.int64), first


def impact(tf: np.ndarray, m: np.ndarray, s: RankSettings) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + s.saturation * m)


def count_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (binary: 64-bit hashes of the distinct terms, 32-bit counts) of every row, in whole texts."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("n_terms", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("tfs", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), 1 << 19):
                terms, first = term_hashes(data, offsets)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                by = np.lexsort((terms, row))
                terms, row = terms[by], row[by]
                new = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (row[1:] != row[:-1]))) if terms.size else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, terms.size)).astype(np.int32)
                at = np.searchsorted(row[new], np.arange(hi - lo + 1))

                def cut(values, width):
                    return pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(values.tobytes())])

                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(np.diff(at)), cut(terms[new], 8), cut(tf, 4)], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Cell:
    """Postings of documents of neighbouring strata, ordered by (stratum, term, tf, document)."""

    _HEAD = struct.Struct("<QQQQ")  # strata, runs, documents, postings

    def __init__(self, payload: bytes):
        strata, runs, docs, postings = self._HEAD.unpack_from(payload)
        at = self._HEAD.size

        def take(kind, n):
            nonlocal at
            a = np.frombuffer(payload, kind, n, at)
            at += a.nbytes
            return a

        self.m, self.ids, self.known = take(np.int64, strata), take(np.int64, docs), take(np.bool_, docs)
        self.stratum, self.term, self.tf, self.begin = take(np.int32, runs), take(np.int64, runs), take(np.int32, runs), take(np.int64, runs + 1)
        self.doc = take(np.int32, postings)
        self.by_term = np.lexsort((self.tf, self.stratum, self.term))
        ordered = self.term[self.by_term]
        self.edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if runs else np.zeros(0, np.int64)
        self.terms = ordered[self.edge]
        self.edge = np.append(self.edge, runs)

    @classmethod
    def pack(cls, ids: np.ndarray, known: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> bytes:
        """``sizes`` distinct terms of each document follow each other in ``terms`` and ``tfs``."""
        strata, stratum = np.unique(m, return_inverse=True)
        doc = np.repeat(np.arange(ids.size, dtype=np.int32), sizes)
        place = stratum.astype(np.int32)[doc]
        by = np.lexsort((tfs, terms, place))
        place, terms, tfs, doc = place[by], terms[by], tfs[by], doc[by]
        new = np.append(True, (place[1:] != place[:-1]) | (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1])) if doc.size else np.zeros(0, bool)
        run = np.flatnonzero(new)
        head = cls._HEAD.pack(strata.size, run.size, ids.size, doc.size)
        return b"".join([head, *(a.tobytes() for a in (strata.astype(np.int64), ids, known, place[run], terms[run], tfs[run], np.append(run, doc.size).astype(np.int64), doc))])

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        """How many documents of the cell hold each of the terms."""
        count = np.diff(np.concatenate([[0], np.cumsum(np.diff(self.begin)[self.by_term])])[self.edge])
        out = np.zeros(terms.size, np.int64)
        if self.terms.size:
            slot = np.minimum(np.searchsorted(self.terms, terms), self.terms.size - 1)
            hit = self.terms[slot] == terms
            out[hit] = count[slot[hit]]
        return out

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int, s: RankSettings) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in ``ids``) and scores of all that may be among the k best, given that a score below ``least`` isn't; more than k are possible."""
        none = np.zeros(0, np.int64)
        if not self.terms.size or not terms.size:
            return none, none
        slot = np.minimum(np.searchsorted(self.terms, terms), self.terms.size - 1)
        hit = np.flatnonzero(self.terms[slot] == terms)
        a, b = self.edge[slot[hit]], self.edge[slot[hit] + 1]
        runs = self.by_term[_spans(a, b - a)]
        weight = np.repeat(weights[hit], b - a)
        which = np.repeat(np.arange(hit.size), b - a)
        place = self.stratum[runs]
        value = weight * impact(self.tf[runs].astype(np.int64), self.m[place], s)  # once for each term, stratum and tf
        # The last run of a (term, stratum) has the largest tf and so the largest value.
        last = np.append((place[1:] != place[:-1]) | (which[1:] != which[:-1]), True) if runs.size else np.zeros(0, bool)
        bound = np.zeros(self.m.size, np.int64)
        np.add.at(bound, place[last], value[last])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rank = np.full(self.m.size, order.size)
        rank[order] = np.arange(order.size)
        by = np.argsort(rank[place], kind="stable")
        runs, value, at = runs[by], value[by], rank[place][by]
        docs, scores, done, step = none, none, 0, 1
        while done < order.size:
            end = min(done + step, order.size)
            end = done + int(np.searchsorted(-bound[order[done:end]], -max(least, 1), "right"))  # strata whose bound reaches the k-th best
            if end == done:
                break
            lo, hi = np.searchsorted(at, [done, end])
            n = self.begin[runs[lo:hi] + 1] - self.begin[runs[lo:hi]]
            doc = self.doc[_spans(self.begin[runs[lo:hi]], n)]
            seen, to = np.unique(doc, return_inverse=True)
            score = np.zeros(seen.size, np.int64)
            np.add.at(score, to, np.repeat(value[lo:hi], n))
            good = score >= max(least, 1)
            docs, scores = np.concatenate([docs, seen[good]]), np.concatenate([scores, score[good]])
            docs, scores, least = best_of(docs, scores, self.ids[docs], self.known[docs], k, least)
            done, step = end, step * 2
        return docs, scores


def best_of(docs: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best, larger scores first, ties by id with NULL last; and the least score that can still be among them."""
    by = np.lexsort((ids, ~known, -scores))[:k]
    return docs[by], scores[by], max(least, int(scores[by[-1]])) if by.size == k else least


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every span, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: RankSettings = RankSettings()) -> tuple[DataFrame, int]:
    """The index of all documents as a written table (payload), and N, the number of documents with at least one term.

    Whole texts are read once and nothing is shuffled: every task orders its own documents by m and packs them into cells of about ``cell_postings`` postings, so
    a stratum that holds a third of all documents is spread over the tasks that read them; a document is never divided. Every row is a document of its own, rows with repeated or NULL ids too. A NULL text, or one without
    terms, is in no stratum. Other columns are ignored. An empty table gives an empty index. Terms are told apart by 64-bit hashes.
    """
    s = settings
    with batch_bytes(docs.sparkSession):
        counted = materialize(count_terms(docs, id_col, text_col).where("n > 0"), "zstd")
    total = counted.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    n_docs = total["N"]
    m = F.lit(100 - s.slope) + F.expr(f"({s.slope} * n * {n_docs}L) div {total['L'] or 1}L")
    sorted_docs = counted.withColumn("m", m.cast("long")).sortWithinPartitions("m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def flush():
            columns = [np.concatenate(c) for c in zip(*parts)]
            return pa.RecordBatch.from_pydict({"payload": pa.array([Cell.pack(*columns)], pa.binary())})

        for batch in batches:
            at = 0
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            while at < sizes.size:  # a batch may hold more than a cell
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + s.cell_postings - size, "right")))
                ids = batch.column(0).slice(at, end - at)
                flat = [np.frombuffer(b"".join(batch.column(c).slice(at, end - at).to_pylist()), kind) for c, kind in ((3, np.int64), (4, np.int32))]
                parts.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)[at:end], sizes[at:end], *flat))
                size += int(sizes[at:end].sum())
                at = end
                if size >= s.cell_postings:
                    yield flush()
                    parts, size = [], 0
        if parts:
            yield flush()

    with batch_bytes(docs.sparkSession):
        return materialize(sorted_docs.select("doc_id", "n_terms", "m", "terms", "tfs").mapInArrow(run, "payload binary"), "zstd", **_CELL_TABLE), n_docs


def _blocks(items: DataFrame, item_col: str, text_col: str, s: RankSettings) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Blocks of items with their distinct terms; rows that share an id make one item."""
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, ceil(chars / s.block_chars))
    rows = materialize(rows.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")))
    for b in range(n):
        block: dict[int | None, list[np.ndarray]] = {}
        for r in rows.where(F.col("b") == b).toLocalIterator():
            raw = np.frombuffer(r["t"].encode(), np.uint8)
            block.setdefault(r["i"], []).append(term_hashes(raw, np.array([0, raw.size]))[0])
        if block:
            yield [(i, np.unique(np.concatenate(t))) for i, t in sorted(block.items(), key=lambda x: (x[0] is None, x[0] or 0))]


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text", settings: RankSettings = RankSettings()) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every item with a score above 0, ties by ascending id (NULL last).

    Items are taken in blocks, whose terms go to the tasks with the task code (two passes over the index per block: document frequencies, then scores). A task keeps the k best of
    each item over all the cells it reads and gives those out, so the merge gets k rows per item and task, and only the k best are written. Rows that share an item id, NULL included, make one item with
    the terms of all of them; an item without terms has no result.
    """
    s = settings
    found = [_search_block(index, n_docs, block, k, s) for block in _blocks(items, item_col, text_col, s)]
    if not found:
        return index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, found)


def _search_block(index: DataFrame, n_docs: int, block: list[tuple[int | None, np.ndarray]], k: int, s: RankSettings) -> DataFrame:
    spark = index.sparkSession
    vocabulary = np.unique(np.concatenate([t for _, t in block]))
    shipped = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shipped.value
        df = np.zeros(terms.size, np.int64)
        for batch in batches:
            for payload in batch.column(0):
                df += Cell(payload.as_py()).frequencies(terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["t", "df"])

    counted = index.mapInArrow(frequencies, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    df = np.zeros(vocabulary.size, np.int64)
    with batch_bytes(spark, rows=1):
        for t, n in counted.collect():  # one row per term of the block
            df[t] = n
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
    wanted = []
    for i, terms in block:
        at = np.searchsorted(vocabulary, terms)
        at = at[weight[at] > 0]
        wanted.append((i, vocabulary[at], weight[at]))
    items = spark.sparkContext.broadcast(wanted)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("item_id", "doc_id", "score")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [[none, none, np.zeros(0, bool), 0] for _ in items.value]  # ids, scores, whether the id is known, least score
        for batch in batches:
            for payload in batch.column(0):
                cell = Cell(payload.as_py())
                for j, (_, terms, weights) in enumerate(items.value):
                    ids, scores, known, least = best[j]
                    docs, more = cell.top(terms, weights, k, least, s)
                    if docs.size:
                        ids, scores, known = np.concatenate([ids, cell.ids[docs]]), np.concatenate([scores, more]), np.concatenate([known, cell.known[docs]])
                        keep, scores, least = best_of(np.arange(ids.size), scores, ids, known, k, least)
                        best[j] = [ids[keep], scores, known[keep], least]
        for (i, *_), (ids, scores, known, _) in zip(items.value, best):
            if ids.size:
                yield pa.RecordBatch.from_arrays([pa.array([i] * ids.size, pa.int64()), pa.array(ids, mask=~known), pa.array(scores)], names=schema.names)

    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = index.mapInArrow(score, schema).withColumn("rank", place).where(F.col("rank") <= k)
    with batch_bytes(spark, rows=1):
        return materialize(ranked.select("item_id", "rank", "doc_id", "score"))
