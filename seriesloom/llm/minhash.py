"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seriesloom.llm.graph import components
from seriesloom.llm.words import mix, shingle_sets, short_batches, text_slices
from seriesloom.operators.joins import keyed_join
from seriesloom.session import materialize


@dataclass(frozen=True)
class MinHashSettings:
    """``rows`` of ``bands`` * ``rows`` coordinates make a band.

    With 24 bands of 4, a pair at the bound of 85 percent shares no band with probability 2e-8, and a pair above it more rarely still.
    ``percent`` is the least similarity: 100 * intersection >= percent * union. ``agree`` is how many coordinates of a
    linked pair must agree before their sets are compared (82 of 96 are expected at the bound, 60 lie six deviations below);
    it is applied only inside large buckets. Buckets of up to ``small`` sets are
    compared by a join, larger ones in blocks of about ``block`` members and ``block_bytes`` of sets.
    """

    shingle: int = 5
    percent: int = 85
    bands: int = 24
    rows: int = 4
    agree: int = 60
    small: int = 16
    block: int = 1024
    block_bytes: int = 32 << 20


_FIRST, _C1, _C2 = np.uint64(0xA24BAED4963EE407), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash coordinates, one row per non-empty set.

    The first permutation places a shingle on a ring of 2**32 places. Coordinate k is the least value that the second
    permutation gives to the places, shifted k steps along the ring.
    """
    flat = np.concatenate(sets)
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    place = (mix(flat ^ _FIRST) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), size), np.uint32)
    for k in range(size):
        v = place - np.uint32(k)
        v ^= v >> np.uint32(16)
        v *= _C1
        v ^= v >> np.uint32(15)
        v *= _C2
        out[:, k] = np.minimum.reduceat(v, begin)
    return out


def _profile(docs: DataFrame, s: MinHashSettings) -> DataFrame:
    """Per document: size of its set, a 128-bit key of the set, band keys and one byte per coordinate."""
    schema = T.StructType([
        T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = s.bands * s.rows
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in text_slices(text, 256 << 10):
                sets = shingle_sets(data, offsets, s.shingle)
                n = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(n)
                k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                bands, sketch = [None] * len(n), [None] * len(n)
                if full.size:
                    held = [sets[i] for i in full]
                    begin = np.cumsum([0] + [len(x) for x in held[:-1]])
                    flat = np.concatenate(held)
                    k1[full], k2[full] = np.add.reduceat(flat, begin), np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), begin)
                    sig = signatures(held, width)
                    h = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64), (len(held), s.bands))
                    for r in range(s.rows):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, r :: s.rows])
                    low = ((sig ^ (sig >> np.uint32(16))) & np.uint32(255)).astype(np.uint8)
                    for j, i in enumerate(full):
                        bands[i], sketch[i] = h[j].view(np.int64), low[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)


def _verified(pairs: DataFrame, docs: DataFrame, s: MinHashSettings) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. Texts are joined by equality, so hot documents can be split; only texts of these pairs are shuffled."""
    pairs = materialize(pairs)
    docs = keyed_join(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), ["id"], "inner")
    sides = pairs.join(docs.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(
        docs.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"
    ).select("a", "b", "ta", "tb")
    kind = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, data, offsets in text_slices(batch.column(2), 1 << 20):
                left = shingle_sets(data, offsets, s.shingle)
                right = [x for _, _, d, o in text_slices(batch.column(3).slice(lo, hi - lo), 1 << 20) for x in shingle_sets(d, o, s.shingle)]
                for i, (x, y) in enumerate(zip(left, right)):
                    both = np.intersect1d(x, y, assume_unique=True).size
                    keep[lo + i] = both > 0 and 100 * both >= s.percent * (x.size + y.size - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return sides.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: MinHashSettings = MinHashSettings()) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, kept.

    A set holds the distinct runs of five words (A-Z lower-cased); documents whose sets reach the similarity are linked, and component_id is
    the smallest id that links reach. kept is true where that is the document's own id.

    1. One pass over the texts makes set key, size and band keys. Documents with one and the same set become one class.
    2. In each bucket every class is paired with the smallest one (a pre-aggregated minimum, no pairs within the bucket), pairs are
       verified on the full sets, and components are formed.
    3. Buckets whose members still lie in several components are looked at again: members outside the component of the smallest one are
       compared with all others of other components. A large bucket is dealt out in blocks, a block against a block per task, which compares signatures
       and then full sets, skips what it has linked already and returns no more links than it has members.

    NULL or blank texts have the size 0, are linked with nothing and are kept. Rows with one id are one document, linked by
    what any of them holds; each gives a row. A NULL id gets the component NULL and is kept. An empty table gives an empty one.
    """
    s = settings
    docs = short_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    seen = materialize(_profile(docs, s))
    full = seen.where("n > 0 AND id IS NOT NULL")
    classes = full.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copies = full.join(classes.where("copies > 1"), ["k1", "k2", "n"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    alone = classes.where("copies = 1").select("rep")
    # The row of the smallest id of a class stands for it; repeated rows of that id count once.
    reps = full.join(classes.select("k1", "k2", "n", "rep").where("copies > 1"), ["k1", "k2", "n"]).where("id = rep").select("k1", "k2", "n", "rep", "bands", "sketch")
    single = full.join(alone, full["id"] == alone["rep"], "left_semi").select("k1", "k2", "n", F.col("id").alias("rep"), "bands", "sketch")
    members = materialize(reps.unionByName(single).dropDuplicates(["k1", "k2", "n", "rep"]).select("rep", "n", "bands", "sketch"))
    placed = members.select("rep", "n", F.explode("bands").alias("key"))
    buckets = materialize(
        placed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("low"), F.count("*").alias("size"), F.sum("n").alias("volume")).where("size > 1").select("key", F.col("low.rep").alias("low"), F.col("low.n").alias("low_n"), "size", "volume")
    )
    held = materialize(placed.join(buckets, "key"))
    fits = f"100 * least(%s) >= {s.percent} * greatest(%s)"
    star = held.where("rep <> low").where(fits % ("n, low_n", "n, low_n")).select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    links = materialize(_verified(star, docs, s).union(copies))
    first = components(links)

    # What the smallest member of a bucket has not brought together.
    named = held.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min(F.struct("rep", "component")).alias("at"))
    mixed = mixed.where("c0 <> c1").select("key", F.col("at.component").alias("low_component"))
    open_ = materialize(named.where("size > 2").join(mixed, "key"))
    few = open_.where(F.col("size") <= s.small).select("key", "rep", "n", "component", "low")
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, F.expr("x.key = y.key AND x.rep < y.rep AND x.component <> y.component AND x.rep <> x.low")).where(fits % ("x.n, y.n", "x.n, y.n"))
    pairs = pairs.select(F.col("y.rep").alias("a"), F.col("x.rep").alias("b")).distinct()
    more = materialize(_verified(pairs, docs, s).union(_blockwise(open_.where(F.col("size") > s.small), members, docs, s)))
    last = first if more.isEmpty() else components(links.union(more))
    out = seen.select("id", "n").join(last.withColumnRenamed("node", "id"), "id", "left")
    # A document without a link is its own component.
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _sets(docs: DataFrame, s: MinHashSettings) -> DataFrame:
    """(rep, n, set): the sorted shingle hashes of each document, 8 bytes each."""
    schema = T.StructType([T.StructField("rep", docs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), 1 << 20):
                sets = shingle_sets(data, offsets, s.shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in sets]), pa.array([x.tobytes() for x in sets], pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _blockwise(open_: DataFrame, members: DataFrame, docs: DataFrame, s: MinHashSettings) -> DataFrame:
    """Links in large buckets: members outside the smallest member's component against all.

    A pair that shares several buckets is looked at in the first of them.
    """
    open_ = open_.select("key", "rep", "n", "component", "low_component", F.ceil(F.greatest(F.col("size") / s.block, F.col("volume") * 8 / s.block_bytes)).cast("int").alias("parts"))
    wanted = open_.select(F.col("rep").alias("id")).distinct()
    sets = _sets(docs.join(wanted, "id", "left_semi"), s).dropDuplicates(["rep", "n"])
    detail = members.select("rep", "n", "bands", "sketch").join(sets, ["rep", "n"])
    rows = open_.withColumn("other", F.col("component") != F.col("low_component")).join(detail, ["rep", "n"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    columns = ("key", "rep", "n", "component", "bands", "sketch", "set")
    asked = rows.where("other").select(*columns, F.lit(True).alias("asked"), F.col("part").alias("i"), F.explode(every).alias("j"))
    held = rows.select(*columns, F.lit(False).alias("asked"), F.explode(every).alias("i"), F.col("part").alias("j"))
    kind = members.schema["rep"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def compare(table: pa.Table) -> pa.Table:
        asked = np.asarray(table["asked"])
        rep, n = table["rep"].to_pylist(), table["n"].to_numpy()
        sketch = np.stack([np.frombuffer(x, np.uint8) for x in table["sketch"].to_pylist()])
        bands = np.array(table["bands"].to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        here = bands == table["key"][0].as_py()
        band = np.argmax(here, axis=1)
        names = {}
        group = np.array([names.setdefault(c, len(names)) for c in table["component"].to_pylist()])
        a, b = [], []
        d = np.flatnonzero(~asked)
        for i in np.flatnonzero(asked).tolist():
            near = d[(group[d] != group[i]) & (100 * np.minimum(n[d], n[i]) >= s.percent * np.maximum(n[d], n[i]))]
            agree = (sketch[near] == sketch[i]).sum(axis=1)
            first = np.argmax(bands[near] == bands[i], axis=1) if near.size else near
            ok = (agree >= s.agree) & (first == band[i])
            for j in near[ok][np.argsort(-agree[ok], kind="stable")].tolist():
                if group[j] == group[i]:
                    continue
                both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                if 100 * both >= s.percent * (n[i] + n[j] - both):
                    group[group == group[j]] = group[i]
                    a.append(max(rep[i], rep[j]))
                    b.append(min(rep[i], rep[j]))
        kind = table.schema.field("rep").type
        return pa.Table.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    return asked.union(held).groupBy("key", "i", "j").applyInArrow(compare, schema)
