"""Nearest neighbours by largest inner product: one vantage-point tree per shard, with a relaxable triangle inequality.

Vectors are lifted onto a sphere: with M the longest length, x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (M q/|q|, 0). Then
|q' - x'|^2 = 2 M^2 - 2 <q, x> M/|q|, so that the nearest point in Euclid's sense has the largest inner product, and distances obey the
triangle inequality, by which a tree leaves out whole branches.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seriesloom.operators.joins import keyed_join
from seriesloom.session import materialize

_HEAD = struct.Struct("<QQQd")  # vectors, dimensions, ids, longest length


@dataclass(frozen=True)
class VPSettings:
    """``factor`` 1 is an exact search; a smaller one leaves out branches that are farther than ``factor`` times the distance of the k-th best
    so far, and may lose neighbours. Shards and blocks of queries are bounded in rows and, for long vectors, in bytes."""

    factor: float = 1.0
    shard_rows: int = 16384
    block_rows: int = 1024
    leaf: int = 256
    cell_bytes: int = 1 << 24


@dataclass
class Tree:
    """Points in the order of the leaves. Node j holds points begin[j]:end[j]; its children are 2j+1 (near) and 2j+2 (far), and lo, hi bound
    the distances of each child's points to the vantage point of their parent."""

    begin: np.ndarray
    end: np.ndarray
    vantage: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    order: np.ndarray


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest * longest - np.einsum("ij,ij->i", x, x), 0.0))
    return np.hstack([x, rest[:, None]])


def grow(points: np.ndarray, leaf: int) -> Tree:
    """A balanced tree: the vantage point of a node is its point farthest from its first one, the median distance divides the rest."""
    n, levels = len(points), 0
    while n > leaf << levels:
        levels += 1
    size = (2 << levels) - 1
    t = Tree(np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros((size >> 1, points.shape[1])), np.zeros(size), np.full(size, np.inf), np.arange(n))
    t.end[0] = n
    for j in range(size >> 1):
        a, b = int(t.begin[j]), int(t.end[j])
        part, mid = points[t.order[a:b]], (a + b) // 2
        far = int(np.argmax(((part - part[0]) ** 2).sum(1)))
        t.vantage[j] = part[far]
        d = np.sqrt(((part - part[far]) ** 2).sum(1))
        by = np.argsort(d, kind="stable")
        t.order[a:b], d = t.order[a:b][by], d[by]
        for child, lo, hi in ((2 * j + 1, a, mid), (2 * j + 2, mid, b)):
            t.begin[child], t.end[child] = lo, hi
            t.lo[child], t.hi[child] = d[lo - a], d[hi - a - 1]
    return t


class Shard:
    """Vectors of a shard, equal ones held once with all their ids, and their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, leaf: int):
        """Rows may come in any order."""
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order] + 0.0)  # -0.0 becomes 0.0
        _, first, which = np.unique(vectors.view(np.dtype((np.void, vectors.strides[0]))).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(which, kind="stable")
        counts = np.bincount(which, minlength=first.size)
        self.longest, self.x = longest, vectors[first]
        self.tree = grow(lift(self.x, longest), leaf)
        place = self.tree.order
        self.x = self.x[place]
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.first = np.concatenate([[0], np.cumsum(counts[place])])
        self.ids = ids[by][np.repeat(starts[place] - self.first[:-1], counts[place]) + np.arange(ids.size)]

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> "Best":
        """The k best of all other rows for each query; sums of products run from the first component to the last."""
        best = Best(len(q), k)
        length = np.sqrt(np.einsum("ij,ij->i", q, q))
        scale = self.longest / length
        lifted = np.hstack([q * scale[:, None], np.zeros((len(q), 1))])
        slack = 1e-11 * self.longest * length
        t, double = self.tree, 2 * self.longest**2
        stack: list[tuple[int, np.ndarray, np.ndarray]] = [(0, np.arange(len(q)), np.full(len(q), -np.inf))]
        while stack:
            j, who, gap = stack.pop()
            reach = np.sqrt(np.maximum(double - 2 * (best.least[who] - slack[who]) * scale[who], 0.0))  # distance of the k-th best
            who = who[gap <= factor * reach + 1e-9 * self.longest]
            if not who.size:
                continue
            if 2 * j + 1 < t.begin.size:
                v = t.vantage[j]
                d = np.sqrt(np.maximum(double - 2 * (lifted[who] @ v), 0.0))
                near, far = (np.maximum(t.lo[c] - d, d - t.hi[c]) for c in (2 * j + 1, 2 * j + 2))
                pair = [(2 * j + 1, who, near), (2 * j + 2, who, far)]
                stack += pair if near.sum() > far.sum() else pair[::-1]  # the child that is closer to more queries comes off first
            elif t.end[j] > t.begin[j]:
                self._leaf(int(t.begin[j]), int(t.end[j]), who, q_ids, q, slack, best)
        return best

    def _leaf(self, a: int, b: int, who: np.ndarray, q_ids: np.ndarray, q: np.ndarray, slack: np.ndarray, best: "Best") -> None:
        rough = q[who] @ self.x[a:b].T
        row, col = np.nonzero(rough >= (best.least[who] - slack[who])[:, None])
        for s in range(0, row.size, 1 << 16):
            r, c = who[row[s : s + (1 << 16)]], col[s : s + (1 << 16)] + a
            score = np.cumsum(q[r] * self.x[c], axis=1)[:, -1]
            copies = np.minimum(self.first[c + 1] - self.first[c], best.k + 1)  # ids are ascending: no more of them can be among the k best
            r, score = np.repeat(r, copies), np.repeat(score, copies)
            ids = self.ids[np.repeat(self.first[c] - np.concatenate([[0], np.cumsum(copies)[:-1]]), copies) + np.arange(r.size)]
            other = ids != q_ids[r]
            best.add(r[other], score[other], ids[other])

    def pack(self) -> bytes:
        t = self.tree
        head = _HEAD.pack(len(self.x), self.x.shape[1], self.ids.size, self.longest)
        return b"".join([head, struct.pack("<Q", t.begin.size), *(a.tobytes() for a in (t.begin, t.end, t.lo, t.hi, t.vantage, self.first, self.ids, self.x))])

    @classmethod
    def unpack(cls, payload: bytes) -> "Shard":
        out = cls.__new__(cls)
        n, dim, ids, out.longest = _HEAD.unpack_from(payload)
        (size,) = struct.unpack_from("<Q", payload, _HEAD.size)
        at = _HEAD.size + 8

        def take(kind, *shape):
            nonlocal at
            a = np.frombuffer(payload, kind, int(np.prod(shape)), at).reshape(shape)
            at += a.nbytes
            return a

        begin, end, lo, hi = take(np.int64, size), take(np.int64, size), take(float, size), take(float, size)
        out.tree = Tree(begin, end, take(float, size >> 1, dim + 1), lo, hi, np.zeros(0, np.int64))
        out.first, out.ids, out.x = take(np.int64, n + 1), take(np.int64, ids), take(float, n, dim)
        return out


class Best:
    """The k best (score, id) of every query: larger scores first, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.row, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not row.size:
            return
        touched = np.zeros(self.least.size, bool)
        touched[row] = True
        mine = touched[self.row]
        r, s, i = (np.concatenate([old[mine], new]) for old, new in ((self.row, row), (self.score, score), (self.ids, ids)))
        by = np.lexsort((i, -s, r))
        r, s, i = r[by], s[by], i[by]
        edge = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        rank = np.arange(r.size) - np.repeat(edge, np.diff(np.append(edge, r.size)))
        keep = rank < self.k
        last = keep & (rank == self.k - 1)
        self.least[r[last]] = s[last]
        self.row, self.score, self.ids = (np.concatenate([old[~mine], new[keep]]) for old, new in ((self.row, r), (self.score, s), (self.ids, i)))


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles), dim of the rows that take part, exact repeats once, and ``_m``, the squared length."""
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = out.where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    out = out.withColumn("_m", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).where((F.col("_m") > 0) & (F.col("_m") < float("inf")))
    return out.withColumn("dim", F.size("v")).dropDuplicates(["id", "v"])


def _cells(dim: Column, rows: int, s: VPSettings) -> Column:
    """Rows of a shard or block: ``rows``, or fewer if they are long."""
    return F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(s.cell_bytes) / (dim * 8)).cast("int")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: VPSettings = VPSettings()) -> DataFrame:
    """The trees as a written table: dim, n_shards, shard, payload.

    Rows are dealt to shards of bounded size by a hash of id and vector, so that copies of one vector spread; a shard holds equal vectors once, with
    all their ids. Vectors that are NULL, zero or hold NULL or non-finite components, vectors whose squared length is no double, and NULL ids are left
    out; exact repeats of a row count once. Vectors of different dimensions have trees of their own. Other columns are ignored; an empty table gives an empty index.
    """
    s = settings
    rows = materialize(_usable(vectors, id_col, vector_col))
    n = F.ceil(F.count(F.lit(1)) / F.first(_cells(F.col("dim"), s.shard_rows, s)))
    stats = rows.groupBy("dim").agg(n.cast("int").alias("n_shards"), F.sqrt(F.max("_m")).alias("longest"))
    dealt = keyed_join(rows.drop("_m"), stats, ["dim"], "inner").withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.col("n_shards")).cast("int"))
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("dim", "n_shards", "shard")] + [T.StructField("payload", T.BinaryType())])

    def build(group: pa.Table) -> pa.Table:
        one = {c: group.column(c)[0].as_py() for c in ("dim", "n_shards", "shard", "longest")}
        # The largest length is recomputed with the sums of this module, which may differ in the last bit.
        x = _matrix(group.column("v"), one["dim"])
        shard = Shard(group.column("id").to_numpy(), x, one.pop("longest") * (1 + 1e-12), s.leaf)
        return pa.table({**{c: pa.array([v], pa.int32()) for c, v in one.items()}, "payload": pa.array([shard.pack()], pa.binary())})

    return materialize(dealt.groupBy("dim", "shard").applyInArrow(build, schema))


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", settings: VPSettings = VPSettings()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of every query with the rows of an index, ties to the smaller id.

    Rows that carry the query's own id are left out. Queries are packed into blocks of bounded size; a block visits every shard of its dimension, each
    visit gives k rows at most per query, and these are merged in two steps. Queries that ``build_index`` would leave out have no result; exact repeats count once.
    With ``factor`` 1 the result is exact; fewer rows than k come back only if there are fewer candidates.
    """
    s = settings
    rows = _usable(queries, id_col, vector_col).drop("_m")
    n = F.ceil(F.count(F.lit(1)) / F.first(_cells(F.col("dim"), s.block_rows, s)))
    rows = materialize(rows)
    stats = rows.groupBy("dim").agg(n.cast("int").alias("n_blocks"))
    dealt = keyed_join(rows, stats, ["dim"], "inner").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("n_blocks")).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        x = np.ascontiguousarray(_matrix(group.column("v"), dim))
        payload = group.column("id").to_numpy().astype(np.int64).tobytes() + x.tobytes()
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([group.column("block")[0].as_py()], pa.int32()), "payload": pa.array([payload], pa.binary())})

    blocks = materialize(dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, payload binary"))
    shards = index.groupBy("dim").agg(F.first("n_shards").alias("n_shards"))
    visits = keyed_join(blocks, shards, ["dim"], "inner").select("dim", F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1)).alias("shard"), "block", "payload")
    both = index.select("dim", "shard", F.lit(-1).alias("block"), "payload").unionByName(visits)
    found = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("best", T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("vec_id", T.LongType())])))])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            for dim, shard, block, payload in zip(*(batch.column(c) for c in range(4))):
                dim, shard, raw = dim.as_py(), shard.as_py(), payload.as_py()
                if block.as_py() < 0:
                    tree, at = Shard.unpack(raw), (dim, shard)
                    continue
                assert at == (dim, shard)  # the shard's own row sorts before its visitors
                n = len(raw) // (8 + 8 * dim)
                ids = np.frombuffer(raw, np.int64, n)
                best = tree.search(ids, np.frombuffer(raw, float, n * dim, 8 * n).reshape(n, dim), k, s.factor)
                by = np.argsort(best.row, kind="stable")
                ends = np.cumsum(np.bincount(best.row, minlength=n)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(best.score[by]), pa.array(best.ids[by])], ["score", "vec_id"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(n, shard, np.int32)), lists], names=found.names)

    parts = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "block").mapInArrow(visit, found)

    def top(column: Column) -> Column:
        less = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)
        return F.slice(F.array_sort(F.flatten(column), less), 1, k)

    merged = parts.groupBy("query_id", F.floor(F.col("shard") / 64).alias("_set")).agg(top(F.collect_list("best")).alias("best"))
    merged = merged.groupBy("query_id").agg(top(F.collect_list("best")).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
