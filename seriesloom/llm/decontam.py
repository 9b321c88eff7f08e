"""Benchmark decontamination: test items found in documents within an edit budget, by pigeonhole pieces and Myers' bit-parallel distance."""

from __future__ import annotations

from math import ceil
from typing import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seriesloom.llm.words import short_batches


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of about equal length and where they begin; within the budget of edits one at least stays whole."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << k)
    return masks


def least_distance(masks: dict[str, int], m: int, text: str, enough: int = 0) -> int:
    """Least edit distance of a pattern of length ``m`` to any substring of ``text`` (stops early once it is ``enough``).

    One column of the distance table is held as two integers of m bits: where it rises and where it falls.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(xh | up)), up & xh
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best = score
                if best <= enough:
                    return best
        rise, fall = (rise << 1) & full, (fall << 1) & full  # a match may begin anywhere: nothing is carried in
        up, down = fall | (full & ~(xv | rise)), rise & xv
    return best


class Items:
    """Test items ready for matching: an automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(len(t) * rate)) for i, t in ((i, normal(t)) for i, t in items) if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            for at, piece in pieces(text, budget):
                where.setdefault(piece, []).append((k, at))
        self.masks: dict[int, dict[str, int]] = {}
        self.finer: dict[int, list[tuple[int, str]]] = {}
        self.automaton = None
        if where:
            self.automaton = ahocorasick.Automaton()
            for piece, uses in where.items():
                self.automaton.add_word(piece, (len(piece), uses))
            self.automaton.make_automaton()

    def likely(self, k: int, begin: int, text: str) -> bool:
        """Whether four of budget + 4 shorter pieces lie whole near their places, as they must if there are no more edits than the budget."""
        _, item, budget = self.items[k]
        if k not in self.finer:
            self.finer[k] = pieces(item, budget + 3)
        spoilt = 0
        for at, piece in self.finer[k]:
            if text.find(piece, max(begin + at - budget, 0), max(begin + at + len(piece) + budget, 0)) < 0:
                spoilt += 1
                if spoilt > budget:
                    return False
        return True

    def find(self, text: str) -> dict[int, int]:
        """Item ids within their budget in a normal text, with the least distance seen around the pieces that hit."""
        found: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()
        for end, (size, uses) in self.automaton.iter(text):
            for k, at in uses:
                begin = end + 1 - size - at
                name, item, budget = self.items[k]
                if found.get(name) == 0 or (k, begin) in seen:
                    continue
                seen.add((k, begin))
                if begin >= 0 and text.startswith(item, begin):
                    found[name] = 0
                    continue
                if budget and self.likely(k, begin, text):
                    if k not in self.masks:
                        self.masks[k] = pattern_masks(item)
                    d = least_distance(self.masks[k], len(item), text[max(begin - budget, 0) : begin + len(item) + budget])
                    if d <= budget and d < found.get(name, budget + 1):
                        found[name] = d
        return found


RESULT = [T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("distances", T.ArrayType(T.LongType()))]


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.1, block_chars: int = 4_000_000, keep: Sequence[str] | None = None) -> DataFrame:
    """Every row with the columns ``keep`` (by default all) and item_ids, in ascending order, and distances of the test items that its text holds; both NULL where there are none.

    An item of n characters (lower-cased, white space as single blanks) matches where a substring of the document lies within floor(``rate`` * n)
    edits of it. Items are looked for in blocks of about ``block_chars`` characters, each broadcast and held against all documents in one pass that adds to what earlier
    passes found, so memory doesn't grow with the benchmark, nothing is joined and a row needs no id. NULL and blank items match nothing, NULL texts hold nothing; items with one id
    count as one, with the least distance. Columns named like the result give way to it. An empty table gives an empty one.
    """
    short_batches(docs)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, ceil(total / block_chars))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("item_ids", "distances")]
    out = docs.select(F.col(text_col), *[F.col(c) for c in keep]).toDF("t", *[f"c{k}" for k in range(len(keep))])
    for k in range(blocks):
        out = _scan(out, [tuple(r) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()], rate, k > 0, k + 1 == blocks)
    return out.toDF(*keep, "item_ids", "distances")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The id, item_ids and distances of every row that holds a test item (see ``mark_contaminated``); rows with one id give a row each."""
    return mark_contaminated(docs, benchmark, text_col, keep=[id_col], **options).where("item_ids IS NOT NULL")


def _scan(docs: DataFrame, items: list[tuple[int, str]], rate: float, later: bool, last: bool) -> DataFrame:
    """Adds what the items of a block hit. The text comes first, and goes with the last block; a later block gets the hits of earlier ones in the last two columns."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    fields = docs.schema.fields[: len(docs.columns) - 2 * later]
    schema = T.StructType([*fields[last:], *RESULT])
    kinds = [pa.list_(pa.int64())] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Items(shared.value, rate)
        for batch in batches:
            found: list[tuple] = []
            for lo in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(lo, 500).to_pylist():
                    found.append(tuple(ready.find(normal(text)).items()) if text and ready.automaton is not None else ())
            if later:
                before = zip(*(batch.column(len(fields) + k).to_pylist() for k in range(2)))
                found = [(*zip(i or (), d or ()), *f) for (i, d), f in zip(before, found)]
            found = [sorted(f) for f in found]
            hits = [pa.array([[x[k] for x in f] or None for f in found], kinds[k]) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[last : len(fields)], *hits], names=schema.names)

    return docs.mapInArrow(run, schema)
