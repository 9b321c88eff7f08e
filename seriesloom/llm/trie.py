"""Prefix trie of conversations, with subtree totals by centroid decomposition."""

from __future__ import annotations

from functools import reduce
from hashlib import sha256
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from seriesloom.operators.index import IDX, LEN, SEG, order_rows
from seriesloom.operators.joins import keyed_join
from seriesloom.session import materialize

#: Components of at most so many nodes are decomposed within a task.
PIECE_NODES = 1 << 15
_PARTS = [f"_s{k}" for k in range(4)]


def turn_rows(turns: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(conv, _idx, mark, chars) of every turn in order, and (conv, _len) of every conversation.

    ``mark`` is a 128-bit hash of role and text, so that texts are read once and never shuffled. Turns are ordered by turn (NULL first), ties by role and then by the hash
    of the text; a NULL role or text is empty; repeated rows are turns of their own; rows with a NULL id are left out. Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), "turn", role.alias("role"), F.md5(text.cast("binary")).alias("_t"), F.length(text).cast("long").alias("chars"),
    )
    ordered = order_rows(rows, ["conv"], ["turn", "role", "_t"])
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "_t").cast("binary"))
    return ordered.indexed().select("conv", IDX, mark.alias("mark"), "chars"), ordered.lengths()


def with_borrowed_starts(rows: DataFrame, lengths: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Give each conversation c the first h turns of conversation c - c % ``every`` in place of its own first h, with h = crc32(c) % (``most`` + 1).

    Returns (conv, depth from 1, mark, chars) and (conv, len). A base that doesn't exist lends nothing, a short one all it has.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("long")
    starts = rows.where((F.col("conv") % every == 0) & (F.col(IDX) < most)).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(IDX, "mark", "chars"))).alias("_start"))
    asked = lengths.withColumn("_h", h).withColumn("_base", F.col("conv") - F.col("conv") % every)
    asked = asked.join(starts.withColumnRenamed("conv", "_base"), "_base", "left")
    lent = F.when(F.col("_h") > 0, F.slice("_start", 1, F.greatest(F.col("_h"), F.lit(1)).cast("int")))
    asked = asked.withColumn("_start", F.coalesce(lent, F.array().cast(starts.schema["_start"].dataType)))
    asked = materialize(asked.withColumn("_k", F.size("_start").cast("long")).withColumn("len", F.col("_k") + F.greatest(F.col(LEN) - F.col("_h"), F.lit(0))))
    own = keyed_join(rows, materialize(asked.select("conv", "_h", "_k")), ["conv"], "inner").where(F.col(IDX) >= F.col("_h"))
    own = own.select("conv", (F.col("_k") + F.col(IDX) - F.col("_h") + 1).alias("depth"), "mark", "chars")
    borrowed = asked.select("conv", F.posexplode("_start").alias("_p", "_t")).select("conv", (F.col("_p") + 1).cast("long").alias("depth"), "_t.mark", "_t.chars")
    return own.unionByName(borrowed), asked.select("conv", "len")


def _key(depth: Column, parts: Sequence[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth, *parts).cast("binary"))


def member_paths(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes on the path of every conversation, as a written table: conv, depth (0: the root), key, parent, chars, left (nodes from here to the end of the path).

    A node's key hashes its depth and four running sums of 32-bit parts of hashes of (depth, mark), so that equal prefixes have equal keys and a conversation of any
    length is summed in range segments, with one row per segment carrying its total on.
    """
    digest = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), "mark").cast("binary"))
    parts = [F.conv(F.substring("_d", 1 + 8 * k, 8), 16, 10).cast("long").alias(p) for k, p in enumerate(_PARTS)]
    ordered = order_rows(rows.withColumn("_d", digest).select("conv", "depth", "chars", *parts), ["conv"], ["depth"])
    within = W.partitionBy("conv", SEG).orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    segments = ordered.rows.groupBy("conv", SEG).agg(*[F.sum(p).alias(f"{p}t") for p in _PARTS])
    before = W.partitionBy("conv").orderBy(SEG).rowsBetween(W.unboundedPreceding, -1)
    segments = segments.select("conv", SEG, *[F.coalesce(F.sum(f"{p}t").over(before), F.lit(0)).alias(f"{p}b") for p in _PARTS])
    summed = ordered.rows.select("conv", SEG, "depth", "chars", *_PARTS, *[F.sum(p).over(within).alias(f"{p}r") for p in _PARTS])
    summed = keyed_join(keyed_join(summed, segments, ["conv", SEG], "inner"), materialize(lengths), ["conv"], "inner")
    now = [F.col(f"{p}b") + F.col(f"{p}r") for p in _PARTS]
    path = summed.select(
        "conv", "depth", _key(F.col("depth"), now).alias("key"), _key(F.col("depth") - 1, [n - F.col(p) for n, p in zip(now, _PARTS)]).alias("parent"),
        "chars", (F.col("len") - F.col("depth") + 1).alias("left"),
    )
    zero = F.lit(0).cast("long")
    root = lengths.select("conv", zero.alias("depth"), _key(zero, [zero] * 4).alias("key"), F.lit(None).cast("string").alias("parent"), zero.alias("chars"), (F.col("len") + 1).alias("left"))
    return materialize(path.unionByName(root))


def trie_nodes(paths: DataFrame) -> DataFrame:
    """One row per node: key, parent, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, chars, weight (path rows in the subtree). Written."""
    nodes = materialize(paths.groupBy("key").agg(
        F.first("parent").alias("parent"), F.min("conv").alias("conv_id"), F.first("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.first("chars").alias("chars"), F.sum("left").alias("weight"),
    ))
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    inner = keyed_join(nodes.select("key", "conv_id"), children.withColumnRenamed("parent", "key"), ["key"], "inner")
    inner = materialize(inner)
    out = keyed_join(nodes, inner.select("key", "n_children"), ["key"])
    out = keyed_join(out, inner.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), ["parent"])
    return materialize(out.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))


def centroid_totals(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals of a forest whose nodes come after their parents (-1: a top), by centroid decomposition of all its components at once.

    In each round every component gives up its deepest node that holds half of it at least. What hangs on that centroid within the component is added to it
    and to every node on its way to the top; its branches and the rest go on as components of their own.
    """
    n, width = values.shape
    up, alive = parent.tolist(), range(n)
    out = [[0] * n for _ in range(width)]
    own = [values[:, c].tolist() for c in range(width)]
    size, top = [0] * n, [0] * n
    while alive:
        totals = [list(c) for c in own]
        for v in alive:
            size[v] = 1
        for v in reversed(alive):
            p = up[v]
            if p >= 0:
                size[p] += size[v]
                for t in totals:
                    t[p] += t[v]
        for v in alive:
            top[v] = v if up[v] < 0 else top[up[v]]
        centroid: dict[int, int] = {}
        for v in reversed(alive):
            if 2 * size[v] >= size[top[v]]:
                centroid.setdefault(top[v], v)
        gone = set(centroid.values())
        for c in gone:
            gain = [t[c] for t in totals]
            v = c
            while v >= 0:
                for o, g in zip(out, gain):
                    o[v] += g
                v = up[v]
        alive = [v for v in alive if v not in gone]
        for v in alive:
            if up[v] in gone:
                up[v] = -1
    return np.array(out, values.dtype).reshape(width, n).T


def rollup(nodes: DataFrame, paths: DataFrame, values: Sequence[str], piece: int = PIECE_NODES) -> DataFrame:
    """key and, for each of ``values`` (long), its total over the node's subtree.

    ``nodes`` has key, parent, conv_id (a member whose path holds the node), depth and weight; ``paths`` has conv, depth, key and parent for each member. Components of more than
    ``piece`` nodes are divided by Spark, all at once in each round: the centroid is the deepest node with half the component's weight, a node lies below it if its
    member's path runs through the centroid, and totals are added along the centroid's path to the top. Smaller components are decomposed within tasks, several at a time. Rounds grow
    with the logarithm of the largest component; NULL values count as 0; an empty table gives an empty one.
    """
    values = list(values)
    sums, adds = [f"_sum_{v}" for v in values], [f"_add_{v}" for v in values]
    state = nodes.select("key", "parent", F.col("conv_id").alias("_member"), "depth", "weight", *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in values])
    # Every tree of the forest begins as a component; a node's top is the first node of its member's path.
    first = paths.where("parent IS NULL").select(F.col("conv").alias("_member"), F.col("key").alias("comp"))
    state = keyed_join(state, first, ["_member"], "inner").withColumns({a: F.lit(0).cast("long") for a in adds})
    state, done, small = materialize(state), [], []
    while True:
        size = materialize(state.groupBy("comp").agg(F.count(F.lit(1)).alias("_n"), F.max("weight").alias("_w")).where(F.col("_n") > piece))
        if size.isEmpty():
            small.append(state)
            break
        sized = keyed_join(state, size.drop("_n"), ["comp"])
        small.append(sized.where("_w IS NULL").drop("_w"))
        large = sized.where("_w IS NOT NULL")
        best = F.min_by(F.struct("key", "_member", "depth", "weight"), F.struct("weight", -F.col("depth"), "key"))
        chosen = large.where("2 * weight >= _w").groupBy("comp").agg(best.alias("_c"))
        chosen = materialize(chosen.select("comp", F.col("_c.key").alias("_ck"), F.col("_c._member").alias("_cm"), F.col("_c.depth").alias("_cd"), F.col("_c.weight").alias("_cw")))
        below = keyed_join(
            paths.where("parent IS NOT NULL").select(F.col("conv").alias("_member"), F.col("key").alias("_next"), F.col("parent").alias("_ck")),
            materialize(chosen.select("_ck", "comp")), ["_ck"], "inner",
        ).select("_member", "comp", "_next")
        parted = keyed_join(keyed_join(large.drop("_w"), materialize(chosen.select("comp", "_ck", "_cd")), ["comp"], "inner"), below, ["_member", "comp"])
        parted = materialize(parted.withColumn("_next", F.when(F.col("depth") > F.col("_cd"), F.col("_next"))).drop("_cd"))
        held = parted.where((F.col("key") == F.col("_ck")) | F.col("_next").isNotNull()).groupBy("comp").agg(*[F.sum(v).alias(s) for v, s in zip(values, sums)])
        chosen = materialize(chosen.join(held, "comp"))
        way = keyed_join(paths.select(F.col("conv").alias("_cm"), F.col("depth").alias("_d"), "key"), chosen, ["_cm"], "inner")
        way = way.where(F.col("_d") <= F.col("_cd")).select("key", "comp", "_cw", *sums)
        parted = keyed_join(parted, way, ["key", "comp"])
        parted = parted.withColumns({a: F.col(a) + F.coalesce(s, F.lit(0)) for a, s in zip(adds, sums)}).withColumn("weight", F.col("weight") - F.coalesce("_cw", F.lit(0)))
        parted = materialize(parted.drop("_cw", *sums))
        done.append(parted.where(F.col("key") == F.col("_ck")).select("key", *[F.col(a).alias(v) for a, v in zip(adds, values)]))
        rest = parted.where(F.col("key") != F.col("_ck"))
        state = materialize(rest.withColumn("comp", F.coalesce("_next", "comp")).drop("_next", "_ck"))
    pieces = reduce(DataFrame.unionByName, small).select("comp", "depth", "key", "parent", *values, *adds)
    schema = T.StructType([T.StructField("key", T.StringType()), *[T.StructField(v, T.LongType()) for v in values]])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def totals(t: pa.Table) -> pa.RecordBatch:
            comp, key, up = (t.column(c).to_pylist() for c in ("comp", "key", "parent"))
            place = {k: i for i, k in enumerate(key)}
            parent = np.array([-1 if k == c else place[p] for k, c, p in zip(key, comp, up)], np.int64)
            order = np.argsort(t.column("depth").to_numpy(), kind="stable")
            back = np.empty_like(order)
            back[order] = np.arange(order.size)
            parent = np.where(parent[order] < 0, -1, back[parent[order]])
            own, extra = (np.stack([t.column(c).to_numpy() for c in names], 1) for names in (values, adds))
            out = centroid_totals(parent, own[order])[back] + extra
            return pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), *[pa.array(out[:, k]) for k in range(len(values))]], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            comp = held.column("comp").combine_chunks()
            if held.num_rows > piece:  # all but the last component are complete
                open_from = pc.index(comp, comp[-1]).as_py()
                if open_from:
                    yield totals(held.slice(0, open_from))
                    held = held.slice(open_from)
        if held is not None and held.num_rows:
            yield totals(held)

    solved = pieces.repartition("comp").sortWithinPartitions("comp").mapInArrow(solve, schema)
    return reduce(DataFrame.unionByName, [solved, *done])


def end_digests(paths: DataFrame) -> DataFrame:
    """key and ends_sha256 of every node where a member ends: the digest of those members' ids in ascending order, joined by commas. A task streams the ids and holds one digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            keys, out = [], []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != at:
                    if at is not None:
                        keys.append(at)
                        out.append(digest.hexdigest())
                    at, digest = key, sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if keys:
                yield pa.RecordBatch.from_pydict({"key": keys, "ends_sha256": out})
        if at is not None:
            yield pa.RecordBatch.from_pydict({"key": [at], "ends_sha256": [digest.hexdigest()]})

    ends = paths.where("left = 1").select("key", "conv")
    return ends.repartition("key").sortWithinPartitions("key", "conv").mapInArrow(run, "key string, ends_sha256 string")


def prefix_trie(rows: DataFrame, lengths: DataFrame, piece: int = PIECE_NODES) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` has conv, depth, mark and chars, ``lengths`` has conv and len, as ``with_borrowed_starts`` makes them. The root has depth 0 and is there if any conversation
    is, turnless ones included. n_leaves counts childless nodes, saved_tokens sums (n_convs - 1) times the code points of the node's text; both over the subtree.
    """
    paths = member_paths(rows, lengths)
    nodes = trie_nodes(paths)
    valued = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
    totals = rollup(valued, paths, ["n_leaves", "saved_tokens"], piece)
    out = keyed_join(keyed_join(nodes, totals, ["key"], "inner"), end_digests(paths), ["key"])
    ends = F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
