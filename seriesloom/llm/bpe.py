"""Byte-level BPE encoding through a memory-mapped lexicon of frequent words, and decoding."""

from __future__ import annotations

import json
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from tokenizers import Tokenizer

from seriesloom.llm.words import short_batches, span_hashes, text_slices
from seriesloom.session import ensure_checkpoint_dir, materialize

# Kinds of bytes: white space, letter, digit, other. 0xC3 leads the letters of Latin-1 (and two signs, see _simple_rows).
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[0x80:0xC0] = _KIND[0xC3] = 1
_KIND[48:58] = 2
_ODD = np.zeros(256, bool)
_ODD[0x1C:0x20] = _ODD[0xC0:0xC3] = _ODD[0xC4:] = True


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Token bytes and merge ranks of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self._library = None
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *special.values()])
        self.tokens = [b""] * size
        for word, i in vocab.items():
            self.tokens[i] = word.encode() if word in special else bytes(alphabet[c] for c in word)
        for word, i in special.items():
            self.tokens[i] = word.encode()
        self.special = [x.encode() for x in special]
        self.bytes_to_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.bytes_to_ids[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = np.array([[vocab[a], vocab[b]] for a, b in pairs], np.int64).reshape(-1, 2).T
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = size
        self._hash_pairs(left * size + right, made)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_offsets = np.concatenate([[0], np.cumsum(lengths)])

    @property
    def library(self) -> Tokenizer:
        """The tokenizers library's own form, made when it is first needed."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _hash_pairs(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Open addressing; the position in ``made`` is the rank."""
        self.mask = (1 << max(4, int(len(keys) * 4).bit_length())) - 1
        self.slot_key = np.full(self.mask + 1, -1, np.int64)
        self.slot_rank = np.full(self.mask + 1, len(keys), np.int64)
        self.made, self.none = np.append(made, -1), len(keys)
        slot = self._slot(keys)
        for k, (key, s) in enumerate(zip(keys.tolist(), slot.tolist())):
            while self.slot_key[s] != -1:
                s = (s + 1) & self.mask
            self.slot_key[s], self.slot_rank[s] = key, k

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of merging each pair; ``none`` where there is no such merge."""
        keys = left * self.size + right
        slot = self._slot(keys)
        out = np.full(keys.size, self.none, np.int64)
        todo = np.arange(keys.size)
        while todo.size:
            found = self.slot_key[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_rank[slot[hit]]
            go = ~hit & (found != -1)
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        return out

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many non-empty words at once, flat, and their number per word.

        In every round each unfinished word merges all places of its lowest-ranked pair, from left to right. A merge that uses a
        merged symbol ranks after the merge that makes it, so this is the order of merging one pair at a time.
        """
        count = ends - starts
        sym = self.bytes_to_ids[data[_flat(starts, count)]]
        word = np.repeat(np.arange(starts.size), count)
        done_sym, done_word = [], []
        while sym.size:
            inner = np.append(word[1:] == word[:-1], False)
            rank = np.full(sym.size, self.none, np.int64)
            at = np.flatnonzero(inner)
            rank[at] = self.ranks(sym[at], sym[at + 1])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, sym.size))
            busy = best < self.none
            if not busy.all():
                over = np.repeat(~busy, size)
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, best, size = sym[keep], word[keep], rank[keep], best[busy], size[busy]
            if not sym.size:
                break
            hit = rank == np.repeat(best, size)
            if (hit[1:] & hit[:-1]).any():  # runs such as aaa: every second place from the left
                place = np.arange(hit.size)
                run = np.maximum.accumulate(np.where(hit, -1, place))
                hit &= (place - run) % 2 == 1
            sym = np.where(hit, self.made[np.where(hit, rank, self.none)], sym)
            keep = np.append(True, ~hit[:-1])
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=starts.size)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows of ids, and where each row begins."""
        begin, size = self.token_offsets[ids], self.token_offsets[ids + 1] - self.token_offsets[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.token_bytes[_flat(begin, size)], total[offsets]


def _flat(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every span, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    full = counts > 0
    starts, counts = starts[full], counts[full]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    step[np.cumsum(counts[:-1])] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(step)


# ---- words -----------------------------------------------------------------------------------------------------------


def _simple_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows in which byte kinds tell letters, digits, white space and the rest apart: ASCII and the letters of Latin-1."""
    odd = _ODD[data]
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    sums = np.concatenate([[0], np.cumsum(odd)])
    return sums[offsets[1:]] == sums[offsets[:-1]]


def split_words(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Where the tokenizer's words begin; words cover every byte. Rows with other scripts are split by the library's own splitter."""
    if not data.size:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    edge[0] = True
    begin = edge[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == 0
    # The last white space before a word stands alone, or joins the word if it is a blank; the rest of its run is one word.
    last = np.zeros(data.size, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    joins = last & (data == 32)
    begin |= last
    begin[1:] &= ~joins[:-1]
    # 's 't 're 've 'm 'll 'd after anything but a blank or another sign.
    quote = np.flatnonzero((data == 39) & begin)
    quote = quote[(quote + 1 < data.size)]
    quote = quote[~edge[quote + 1]]
    if quote.size:
        padded = np.append(data, np.zeros(2, np.uint8))
        a, b = padded[quote + 1], padded[quote + 2]
        two = ((a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108)) & ~edge[np.minimum(quote + 2, data.size)]
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        for length, which in ((1, one), (2, two & ~one)):
            q = quote[which]
            begin[q + 1] = False
            if length == 2:
                begin[q + 2] = False
            after = q + length + 1
            begin[after[after < data.size]] = True
            # A blank after the ending joins the next word as before.
    odd = np.flatnonzero(~_simple_rows(data, offsets))
    for r in odd.tolist():
        lo, hi = int(offsets[r]), int(offsets[r + 1])
        text = data[lo:hi].tobytes().decode("utf-8")
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]) if len(text) != hi - lo else None
        begin[lo:hi] = False
        for _, (s, _e) in vocabulary.library.pre_tokenizer.pre_tokenize_str(text):
            begin[lo + (int(at[s]) if at is not None else s)] = True
    return np.flatnonzero(begin)


# ---- lexicon ---------------------------------------------------------------------------------------------------------


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words, built word by word, as dense tables.

    ``next`` holds the target of every state and byte class (0: none), ``skip`` how many words come before the ones behind that
    step. The skips on a word's way add up to its number, which is the place of its ids.
    """
    edges: list[dict[int, int]] = [{}, {}]  # 0: nowhere, 1: root
    final = [False, False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # parent, byte, child of the last word
    spare: list[int] = []
    last = b""

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            key = (final[child], tuple(sorted(edges[child].items())))
            same = register.setdefault(key, child)
            if same != child:
                edges[parent][byte] = same
                edges[child], final[child] = {}, False
                spare.append(child)

    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        settle(common)
        at = path[-1][2] if path else 1
        for byte in w[common:]:
            if spare:
                new = spare.pop()
            else:
                new = len(edges)
                edges.append({})
                final.append(False)
            edges[at][byte] = new
            path.append((at, byte, new))
            at = new
        final[at] = True
        last = w
    settle(0)
    below = [-1] * len(edges)
    stack = [1]
    while stack:
        s = stack[-1]
        todo = [t for t in edges[s].values() if below[t] < 0]
        if todo:
            stack += todo
        else:
            below[s] = int(final[s]) + sum(below[t] for t in edges[s].values())
            stack.pop()
    used = sorted({b for e in edges for b in e})
    classes = np.zeros(256, np.uint8)
    classes[used] = np.arange(1, len(used) + 1)
    step = np.zeros((len(edges), len(used) + 1), np.int32)
    skip = np.zeros_like(step)
    for s, out in enumerate(edges):
        n = int(final[s])
        for byte, t in sorted(out.items()):
            step[s, classes[byte]], skip[s, classes[byte]] = t, n
            n += below[t]
    return {"classes": classes, "next": step, "skip": skip, "final": np.array(final)}


class Lexicon:
    """Words with their ids in one file that tasks map into memory."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.__dict__.update(parts)

    @staticmethod
    def pack(words: list[bytes], vocabulary: Vocabulary) -> bytes:
        words = sorted(set(words) - {b""})
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
        ids, counts = vocabulary.merge(np.frombuffer(b"".join(words), np.uint8), starts, ends)
        parts = build_automaton(words) | {"ids": ids, "offsets": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)}
        head, body, at = {}, [], 0
        for name, x in parts.items():
            pad = -at % 64
            body.append(b"\0" * pad + x.tobytes())
            head[name] = [x.dtype.str, x.shape, at + pad]
            at += pad + x.nbytes
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 64)
        return len(text).to_bytes(8, "little") + text + b"".join(body)

    @classmethod
    def open(cls, path: str) -> "Lexicon":
        raw = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        head, base = json.loads(raw[8 : 8 + size].tobytes()), 8 + size
        parts = {}
        for name, (kind, shape, at) in head.items():
            n = int(np.prod(shape)) * np.dtype(kind).itemsize
            parts[name] = raw[base + at : base + at + n].view(kind).reshape(shape)
        return cls(parts)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word in the lexicon, -1 if it isn't there; all words walk side by side."""
        out = np.full(starts.size, -1, np.int64)
        kinds = self.classes[data]
        width = self.next.shape[1]
        steps, skips = self.next.reshape(-1), self.skip.reshape(-1)
        who, at, left = np.arange(starts.size), starts.copy(), ends - starts
        state, number = np.ones(starts.size, np.int64), np.zeros(starts.size, np.int64)
        while who.size:
            cell = state * width + kinds[at]
            state = steps[cell].astype(np.int64)
            number += skips[cell]
            left -= 1
            ended = (left == 0) & (state > 0)
            hit = ended & self.final[state]
            out[who[hit]] = number[hit]
            go = (state > 0) & (left > 0)
            who, at, left, state, number = who[go], at[go] + 1, left[go], state[go], number[go]
        return out


class Encoder:
    """Encodes slices of texts; remembers up to ``memory`` words that are not in the lexicon (a cache, emptied when full).

    With ``library_only`` the tokenizers library itself encodes every word that has not been met, once.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, memory: int = 400_000, library_only: bool = False):
        self.v, self.lexicon, self.memory, self.library_only = vocabulary, lexicon, memory, library_only
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at = self.known_count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        if self.library_only:
            ids, counts = self._by_library([data[a:b].tobytes().decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist())])
        else:
            ids, counts = self.v.merge(data, starts, ends)
        at = self.pool.size + np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
        self.pool = np.concatenate([self.pool, ids])
        merged = np.concatenate([self.known, hashes])
        order = np.argsort(merged, kind="stable")
        self.known = merged[order]
        self.known_at = np.concatenate([self.known_at, at])[order]
        self.known_count = np.concatenate([self.known_count, counts])[order]

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words. A blank and letters stay one word wherever they stand, so such words are encoded as one text of many."""
        found: list[np.ndarray | None] = [None] * len(words)
        plain = [k for k, w in enumerate(words) if w[0] == " " and w[1:].isalpha()]
        for lo in range(0, len(plain), 4096):
            group = plain[lo : lo + 4096]
            e = self.v.library.encode("".join(words[k] for k in group), add_special_tokens=False)
            size = np.bincount(np.array(e.word_ids, np.int64), minlength=len(group))
            if size.size == len(group):
                for k, ids in zip(group, np.split(np.array(e.ids, np.uint32), np.cumsum(size)[:-1])):
                    found[k] = ids
        rest = [k for k, f in enumerate(found) if f is None]
        for lo in range(0, len(rest), 4096):
            group = rest[lo : lo + 4096]
            for k, e in zip(group, self.v.library.encode_batch_fast([words[k] for k in group], add_special_tokens=False)):
                found[k] = np.array(e.ids, np.uint32)
        return np.concatenate(found), np.array([len(f) for f in found], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, flat, and where each row begins."""
        starts = split_words(data, offsets, self.v)
        ends = np.append(starts[1:], data.size)
        number = self.lexicon.find(data, starts, ends) if self.lexicon is not None else np.full(starts.size, -1)
        begin, count = np.zeros(starts.size, np.int64), np.zeros(starts.size, np.int64)
        listed = number >= 0
        base = 0
        if listed.any():
            begin[listed] = self.lexicon.offsets[number[listed]]
            count[listed] = self.lexicon.offsets[number[listed] + 1] - begin[listed]
            base = self.lexicon.ids.size
        rest = np.flatnonzero(~listed)
        if rest.size:
            h = span_hashes(data, starts[rest], ends[rest])
            distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
            if self.known.size > self.memory:
                self._forget()
            at = np.minimum(np.searchsorted(self.known, distinct), max(self.known.size - 1, 0))
            new = np.ones(distinct.size, bool) if not self.known.size else self.known[at] != distinct
            if new.any():
                w = rest[where[new]]
                self._learn(data, starts[w], ends[w], distinct[new])
                at = np.searchsorted(self.known, distinct)
            begin[rest] = base + self.known_at[at][back]
            count[rest] = self.known_count[at][back]
        pool = np.concatenate([self.lexicon.ids, self.pool]) if base else self.pool
        ids = pool[_flat(begin, count)]
        total = np.concatenate([[0], np.cumsum(count)])
        bounds = total[np.searchsorted(starts, offsets)]
        return self._with_special(data, offsets, ids, bounds)

    def _with_special(self, data, offsets, ids, bounds):
        """Texts that spell a special token are left to the library, which reads it as that token."""
        raw = data.tobytes()
        rows = set()
        for s in self.v.special:
            at = raw.find(s)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(s, at + 1)
        if not rows:
            return ids, bounds
        parts = [ids[bounds[r] : bounds[r + 1]] for r in range(offsets.size - 1)]
        for r in rows:
            text = raw[offsets[r] : offsets[r + 1]].decode("utf-8", "replace")
            parts[r] = np.array(self.v.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


# ---- Spark -----------------------------------------------------------------------------------------------------------

_held: dict = {}


def vocabulary_of(path: str) -> Vocabulary:
    """One copy per Python worker."""
    if path not in _held:
        _held[path] = Vocabulary(path)
    return _held[path]


def _encoder_of(path: str, file: str | None, **options) -> Encoder:
    key = (path, file, *sorted(options.items()))
    if key not in _held:
        for k in [k for k in _held if isinstance(k, tuple)]:
            del _held[k]
        _held[key] = Encoder(vocabulary_of(path), Lexicon.open(SparkFiles.get(file)) if file else None, **options)
    return _held[key]


def word_counts(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """(word, n): how often each of the tokenizer's words occurs in all texts; tasks add up their own words first."""
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(path)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), 2 << 20):
                starts = split_words(data, offsets, v)
                ends = np.append(starts[1:], data.size)
                short = ends - starts <= 64
                starts, ends = starts[short], ends[short]
                _, at, n = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
                size = ends[at] - starts[at]
                where = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                words = pa.Array.from_buffers(pa.binary(), at.size, [None, where, pa.py_buffer(data[_flat(starts[at], size)])])
                yield pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "n"])

    return docs.select(text_col).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, size: int) -> list[bytes]:
    """At most ``size`` of the most frequent words: the largest number whose least count can be told from a small histogram of counts.

    Only the histogram (eight bars per doubling) and the chosen words reach the driver, however many tasks there are.
    """
    counts = materialize(counts)
    bar = F.floor(F.log2("n") * 8).cast("int")
    room, least = size, None
    for r in counts.groupBy(bar.alias("bar")).count().orderBy(F.desc("bar")).collect():
        if r["count"] > room:
            break
        room, least = room - r["count"], r["bar"]
    return [] if least is None else [bytes(r["word"]) for r in counts.where(bar >= least).select("word").collect()]


def ship_lexicon(spark: SparkSession, words: list[bytes], path: str) -> str:
    """Write the lexicon to the shared folder and give each executor a copy, which its tasks map into memory. Returns its name."""
    ensure_checkpoint_dir(spark)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    name = f"lexicon-{uuid.uuid4().hex}"
    target = jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/{name}")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    packed = Lexicon.pack(words, vocabulary_of(path))
    for k in range(0, len(packed), 4 << 20):
        out.write(bytearray(packed[k : k + (4 << 20)]))
    out.close()
    sc.addFile(target.toString())
    return name


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_size: int = 40_000) -> DataFrame:
    """``id_col`` and ``ids``: the ids of every whole text as little-endian unsigned 32-bit integers, one row per input row.

    At most ``lexicon_size`` of the most frequent words of all texts (of at most 64 bytes, so the file's size is bounded) are compiled with
    their ids into the automaton; other words are merged exactly. NULL and empty texts have no ids; an empty table gives an empty one;
    other columns are left out.
    """
    spark = docs.sparkSession
    docs = short_batches(docs.select(id_col, text_col))
    file = ship_lexicon(spark, frequent_words(word_counts(docs, text_col, path), lexicon_size), path)
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder_of(path, file)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), 1 << 20):
                ids, bounds = encoder.encode(data, offsets)
                where = pa.py_buffer((bounds * 4).astype(np.int32))
                column = pa.Array.from_buffers(pa.binary(), hi - lo, [None, where, pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), column], names=schema.names)

    return docs.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Add the text that ``ids_col`` spells; bytes that are no UTF-8 become U+FFFD. NULL ids give an empty text."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])
    place = short_batches(encoded).columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(path)
        for batch in batches:
            column = batch.column(place).fill_null(b"").cast(pa.large_binary())
            bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
            row = 0
            while row < len(column):
                end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + (4 << 20), "right")) - 1)
                raw = column.buffers()[2]
                ids = np.frombuffer(raw, "<u4", int(bounds[end] - bounds[row]) // 4, int(bounds[row])) if bounds[end] > bounds[row] else np.zeros(0, "<u4")
                data, at = v.decode(ids.astype(np.int64), (bounds[row : end + 1] - bounds[row]) // 4)
                text = pa.Array.from_buffers(pa.binary(), end - row, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
                try:
                    text = text.cast(pa.string())
                except pa.ArrowInvalid:
                    text = pa.array([x.decode("utf-8", "replace") for x in text.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([c.slice(row, end - row) for c in batch.columns] + [text], names=schema.names)
                row = end

    return encoded.mapInArrow(run, schema)


__all__ = ["bpe_encode", "bpe_decode", "Encoder", "Lexicon", "Vocabulary"]
