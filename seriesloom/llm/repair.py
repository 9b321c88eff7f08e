"""Token ids of documents in binary shards, compressed by Re-Pair grammars that can be read at any place."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from seriesloom.llm.bpe import _encoder_of, _flat
from seriesloom.llm.words import short_batches, text_slices

_MAGIC = b"RPR1"
_HEAD = struct.Struct("<4sIIQQB7x")  # magic, first rule id, rules, documents, symbols, bytes per symbol


@dataclass(frozen=True)
class RePairSettings:
    """A round replaces all pairs at least 1/``ratio`` as frequent as the most frequent one, until no pair is found ``least`` times."""

    shard_tokens: int = 1 << 20
    least: int = 16
    ratio: int = 32
    end_id: int = 2


def compress(ids: np.ndarray, bounds: np.ndarray, base: int, settings: RePairSettings = RePairSettings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where each document's symbols begin, and rules (left, right); rule k has the id base + k.

    All pairs are counted once; after that only those whose count may matter still: pairs found ``least`` times, and pairs beside a replaced place.
    No pair spans two documents. Where chosen pairs overlap, the more frequent one is taken; the rest waits for a later round.
    """
    seq = ids.astype(np.int32)
    last = np.zeros(seq.size, bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    open_ = ~last  # places whose pair may still be frequent
    rules: list[np.ndarray] = []
    top = base
    while True:
        place = np.flatnonzero(open_)
        if not place.size:
            break
        pairs, start, count, place = _group(seq, place)
        most = int(count.max())
        if most < settings.least:
            break
        chosen = np.flatnonzero(count >= max(settings.least, most // settings.ratio))
        chosen = chosen[np.lexsort((pairs[chosen], -count[chosen]))]
        order = np.where(count >= settings.least, chosen.size, chosen.size + 1).astype(np.int32)
        order[chosen] = np.arange(chosen.size)
        padded = np.full(seq.size + 2, chosen.size + 1, np.int32)
        rank, before, after = padded[1:-1], padded[:-2], padded[2:]
        rank[place] = np.repeat(order, count)
        open_ = rank <= chosen.size
        take = (rank < before) & (rank <= after) & (rank < chosen.size)
        again = np.flatnonzero((rank == before) & (rank < chosen.size))
        if again.size:  # of a run such as aaa every second place
            first = np.append(True, np.diff(again) != 1)
            step = np.arange(again.size) - np.maximum.accumulate(np.where(first, np.arange(again.size), 0))
            again = again[step % 2 == 1]
            take[again] = rank[again] <= after[again]
        at = np.flatnonzero(take)
        taken = np.bincount(rank[at], minlength=chosen.size) > 0
        pairs = pairs[chosen[taken]]
        rules.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1))
        seq[at] = top + (np.cumsum(taken) - 1)[rank[at]]
        last[at] = last[at + 1]
        open_[at] = True  # only pairs with a new symbol are new
        open_[at[at > 0] - 1] = True
        keep = np.ones(seq.size, bool)
        keep[at + 1] = False
        seq, last, open_ = seq[keep], last[keep], open_[keep]
        open_ &= ~last
        top += pairs.size
    full = bounds[1:] > bounds[:-1]
    size = np.zeros(bounds.size - 1, np.int64)
    size[full] = np.diff(np.append(-1, np.flatnonzero(last)))
    return seq, np.concatenate([[0], np.cumsum(size)]), np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def _group(seq: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (left << 32 | right) at the places, where each one's places begin, how many they are, and the places in that order."""
    key, right = seq[place].astype(np.int64), seq[place + 1].astype(np.int64)
    low, high = int(place[-1]).bit_length(), int(max(key.max(), right.max())).bit_length()
    if low + 2 * high < 64:  # one sort of plain numbers gives the order and the places
        key <<= high
        key |= right
        key <<= low
        key |= place
        key.sort()
        place = key & ((1 << low) - 1)
        key >>= low
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        pairs = ((key[start] >> high) << 32) | (key[start] & ((1 << high) - 1))
    else:
        key = (key << 32) | right
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        pairs = key[start]
    return pairs, start, np.diff(np.append(start, place.size)), place


def pack_shard(doc_ids: np.ndarray, ids: np.ndarray, bounds: np.ndarray, base: int, settings: RePairSettings = RePairSettings()) -> bytes:
    """The bytes of one shard: header, rules, length of each rule's expansion, ids of the documents, where their symbols begin, symbols."""
    seq, begin, rules = compress(ids, bounds, base, settings)
    kind = "<u2" if base + len(rules) <= 1 << 16 else "<u4"
    head = _HEAD.pack(_MAGIC, base, len(rules), bounds.size - 1, seq.size, 2 if kind == "<u2" else 4)
    return b"".join([head, rules.astype("<u4").tobytes(), _lengths(rules, base).astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), begin.astype("<u8").tobytes(), seq.astype(kind).tobytes()])


def _lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = np.ones(base + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[base + k] = out[a] + out[b]
    return out[base:]


class Shard:
    """Reads documents, or parts of them, from a shard's bytes."""

    def __init__(self, payload: bytes):
        magic, self.base, n, docs, size, width = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a shard")
        at = _HEAD.size
        take = lambda kind, k: np.frombuffer(payload, kind, k, at)
        self.rules = take("<u4", 2 * n).reshape(n, 2).astype(np.int64)
        at += 8 * n
        self.lengths = take("<u4", n).astype(np.int64)
        at += 4 * n
        self.doc_ids = take("<i8", docs)
        at += 8 * docs
        self.begin = take("<u8", docs + 1).astype(np.int64)
        at += 8 * (docs + 1)
        self.symbols = take(f"<u{width}", size)

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(symbols.size, np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a run of symbols: rules are opened level by level."""
        symbols = symbols.astype(np.int64)
        while True:
            rule = symbols >= self.base
            if not rule.any():
                return symbols.astype(np.uint32)
            at = np.cumsum(1 + rule) - (1 + rule)
            out = np.empty(symbols.size + int(rule.sum()), np.int64)
            out[at] = symbols
            out[at[rule]] = self.rules[symbols[rule] - self.base, 0]
            out[at[rule] + 1] = self.rules[symbols[rule] - self.base, 1]
            symbols = out

    def read(self, row: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids [start, stop) of one document; lengths of expansions lead to the symbols that hold them, and only those are opened."""
        symbols = self.symbols[self.begin[row] : self.begin[row + 1]].astype(np.int64)
        ends = np.cumsum(self.sizes(symbols))
        stop = int(ends[-1]) if ends.size and stop is None else min(stop or 0, int(ends[-1]) if ends.size else 0)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(symbols[a:b])[skip : skip + stop - start]

    def read_all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document begins. Every rule is opened once; symbols then copy their expansions."""
        opened = self.expand(np.arange(self.base, self.base + self.lengths.size))
        words = np.concatenate([np.arange(self.base, dtype=np.uint32), opened])
        begin = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths])
        sizes = self.sizes(self.symbols)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return words[_flat(begin[self.symbols], sizes)], total[self.begin]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", settings: RePairSettings = RePairSettings()) -> None:
    """Encode every whole text, append ``end_id``, and write shards of about ``shard_tokens`` ids in ascending order of ``id_col``.

    The folder is a Parquet table of (part, seq, first_doc, n_docs, n_tokens, payload), so that Spark's commit protocol guards the files in
    any store. Rows of one id follow each other in the order of a hash of their texts; ids must be integers; NULL ids are refused before anything is written. NULL and empty texts have
    the end id alone. The tokenizers library encodes each distinct word that a task meets; a text that spells a special token is encoded by it as a whole.
    """
    if not docs.where(F.col(id_col).cast("long").isNull()).isEmpty():
        raise ValueError(f"column {id_col} holds NULL or a value that is no integer; shards need an id for every document")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = short_batches(docs).repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "seq", "first_doc", "n_docs", "n_tokens")] + [T.StructField("payload", T.BinaryType())])
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder_of(tokenizer, None, library_only=True, memory=1_000_000), TaskContext.get().partitionId(), 0
        ids, counts, names, size = [], [], [], 0

        def flush():
            nonlocal ids, counts, names, size, seq
            n = np.concatenate(counts)
            row = [part, seq, int(names[0][0]), n.size, int(n.sum()), pack_shard(np.concatenate(names), np.concatenate(ids), np.concatenate([[0], np.cumsum(n)]), encoder.v.size, s)]
            ids, counts, names, size, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(schema.fields, row)})

        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_slices(batch.column(1), 2 << 20):
                flat, at = encoder.encode(data, offsets)
                n = np.diff(at)
                ended = np.full(flat.size + n.size, s.end_id, np.uint32)
                ended[_flat(at[:-1] + np.arange(n.size), n)] = flat
                ids.append(ended)
                counts.append(n + 1)
                names.append(doc_ids[lo:hi])
                size += ended.size
                if size >= s.shard_tokens:
                    yield flush()
        if size:
            yield flush()

    docs.mapInArrow(run, schema).write.parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document as the files hold it: doc_id, start (ids before it), n_tokens, ids (binary, little-endian unsigned 32-bit).

    Offsets come from the totals of parts, then of shards within a part.
    """
    shards = spark.read.parquet(folder)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    at = shards.select("part", "seq", "n_tokens").join(parts, "part")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens") + F.col("part_start")
    at = at.select("part", "seq", before.alias("shard_start"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, start in zip(batch.column(0), batch.column(1).to_pylist()):
                shard = Shard(payload.as_py())
                ids, begin = shard.read_all()
                column = pa.Array.from_buffers(pa.binary(), shard.doc_ids.size, [None, pa.py_buffer((begin * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids), pa.array(begin[:-1] + start), pa.array(np.diff(begin)), column], names=schema.names)

    return shards.select("part", "seq", "payload").join(at, ["part", "seq"]).select("payload", "shard_start").mapInArrow(run, schema)


