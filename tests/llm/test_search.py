"""Nearest neighbours, ranked search and the prefix trie against brute force, on small tables with awkward rows."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import queries as Q, ranked, vptree
from seriesloom.llm.ranked import Cell, RankSettings
from seriesloom.llm.trie import centroid_totals, prefix_trie, turn_rows, with_borrowed_starts
from seriesloom.llm.vptree import VPSettings

SF = "/root/testdata/sf0.001"


# ---- nearest neighbours ------------------------------------------------------------------------------------------------


def nearest(rows, queries, k):
    ok = {(i, tuple(float(x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in sorted(x for x in ok if x[0] in queries):
        best = []
        for i, w in ok:
            if i != q and len(w) == len(v):
                s = 0.0
                for a, b in zip(v, w):
                    s += a * b
                best.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(best)[:k])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, score string, shard string, payload string, dim string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "s", "h", "p", "d") for i, v in rows], VECTORS).repartition(3)


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * rng.choice([0.1, 1, 30])).tolist()) for i in range(300)]
    rows += [(300 + i, [float(x) for x in rng.integers(-1, 2, 5)]) for i in range(80)]  # ties, and a few zero vectors
    rows += [(400 + i, [2.0, 0.0, -1.0, 0.0, 0.0]) for i in range(120)]  # a large group of copies
    rows += [(520, None), (521, []), (522, [0.0] * 5), (523, [1.0, None, 0, 0, 0]), (524, [math.nan] * 5), (525, [math.inf, 0, 0, 0, 0]), (None, [1.0] * 5)]
    rows += [(526, [1.0, 2.0]), (527, [3.0, -1.0]), (7, rows[7][1]), (-20, [0.5] * 5), (540, [1.0, 1.0, 1.0])]
    df = vectors(spark, rows)
    for s in (VPSettings(), VPSettings(shard_rows=40, block_rows=7, leaf=8)):
        got = vptree.search(vptree.build_index(df, settings=s), df.where("vec_id % 10 = 0"), 6, settings=s)
        assert sorted(map(tuple, got.collect())) == nearest(rows, {i for i, _ in rows if i is not None and i % 10 == 0}, 6)
    few = vectors(spark, rows[:3])
    assert got.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:double>"
    assert vptree.search(vptree.build_index(few), few, 20).count() == 6
    none = vectors(spark, [])
    assert vptree.search(vptree.build_index(none), df).count() == 0 and vptree.search(vptree.build_index(df), none).count() == 0


def test_relaxed_factor_visits_less_and_keeps_most():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    seen = []

    class Counted(vptree.Shard):
        def _leaf(self, a, b, who, *rest):
            seen.append((b - a) * len(who))
            super()._leaf(a, b, who, *rest)

    shard = Counted(np.arange(4000), x, 1 + 1e-12, 64)
    want = np.argsort(-(x[:100] @ x.T) + np.eye(100, 4000) * 9, axis=1, kind="stable")[:, :20]
    work = {}
    for factor in (1.0, 0.5):
        seen.clear()
        best = shard.search(np.arange(100), x[:100], 20, factor)
        found = [set(best.ids[best.row == q].tolist()) for q in range(100)]
        recall = np.mean([len(f & set(w.tolist())) / 20 for f, w in zip(found, want)])
        work[factor] = sum(seen)
        assert recall == 1 if factor == 1 else recall >= 0.9
    assert work[0.5] < work[1.0] < 100 * 4000
    again = vptree.Shard.unpack(shard.pack())
    assert np.array_equal(again.search(np.arange(100), x[:100], 20, 1.0).ids, shard.search(np.arange(100), x[:100], 20, 1.0).ids)


# ---- ranked search -----------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranking(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in wanted.items():
        scored = []
        for d, c, size in counts:
            m = 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def test_ranking_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["Alpha", "beta", "gámma", "δελτα", "e1", "the", "THE", "日本", "x", "zz9"] + [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(rng.choices(words, [5] * 10 + [1] * 60, k=rng.choice([1, 3, 20, 200])))) for i in range(300)]
    docs += [(300 + i, "the same copy of alpha beta, gámma w1 w2") for i in range(150)]
    docs += [(500, None), (501, ""), (502, " -\n\x7f.."), (503, "w5-w5_w5`W5"), (None, "alpha w3 w3"), (None, "alpha w3 w3"), (9, "alpha"), (504, "The " * 30000 + "w7"), (505, "a\x00b İ ſ")]
    items = [(1, "Alpha beta w1"), (2, "the THE the"), (3, None), (4, "nowhere else"), (5, "w3 日本 gámma δελτα w9 w10 W11"), (1, "w2 w7"), (None, "w5 a"), (6, " ".join(words))]
    table = spark.createDataFrame([(i, t, "x", 1.5, "y", "z") for i, t in docs], "doc_id long, text string, n string, m double, tf string, payload string").repartition(4)
    asked = spark.createDataFrame([(i, t, 3, "s") for i, t in items], "item_id long, text string, score long, rank string")
    for s in (RankSettings(), RankSettings(cell_postings=300, block_chars=20)):
        index, n = ranked.build_index(table, settings=s)
        got = ranked.search(index, n, asked, 12, settings=s)
        assert sorted(map(tuple, got.collect()), key=repr) == ranking(docs, items, 12)
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
    assert ranked.search(index, n, asked.limit(0)).count() == 0
    empty, zero = ranked.build_index(table.limit(0))
    assert zero == 0 and ranked.search(empty, zero, asked).count() == 0


def test_few_cells_are_held_at_once(spark, monkeypatch):
    import pyarrow.parquet as pq

    limits = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(key) for key in limits]
    read, write = [], ranked.materialize

    def noted(df, *args, **options):
        read.append(spark.conf.get(limits[0]))
        return write(df, *args, **options)

    monkeypatch.setattr(ranked, "materialize", noted)
    docs = [(i, f"alpha w{i % 7} w{i % 11}") for i in range(400)]
    s = RankSettings(cell_postings=30)
    index, n = ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), settings=s)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == index.count() > 30
    assert max(g.num_rows for g in groups) <= 8 and not any(g.column(0).is_stats_set for g in groups)
    read.clear()
    got = ranked.search(index, n, spark.createDataFrame([(1, "alpha w3"), (None, "w5")], "item_id long, text string"), 5, settings=s)
    assert read[-1] == "1" and [spark.conf.get(key) for key in limits] == before
    assert got.inputFiles() and sorted(map(tuple, got.collect()), key=repr) == ranking(docs, [(1, "alpha w3"), (None, "w5")], 5)


def test_strata_are_left_out_by_their_bounds():
    n = 4000
    rng = np.random.default_rng(1)
    m = np.sort(rng.integers(50, 400, n))
    sizes = np.ones(n, np.int64)
    cell = Cell(Cell.pack(np.arange(n), np.ones(n, bool), m, sizes, np.full(n, 7), rng.integers(1, 3, n).astype(np.int32)))
    docs, scores = cell.top(np.array([7]), np.array([1000]), 5, 0, RankSettings())
    assert docs.size == 5 and (np.diff(scores) <= 0).all()
    more, _ = Cell(Cell.pack(np.arange(n), np.ones(n, bool), m, sizes, np.full(n, 7), np.ones(n, np.int32))).top(np.array([7]), np.array([1000]), 5, int(scores[-1]) + 1, RankSettings())
    assert more.size == 0  # nothing reaches a score that was reached elsewhere


# ---- prefix trie -------------------------------------------------------------------------------------------------------


def trie(rows):
    """rows: (conv, turn, role, text)."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    from hashlib import md5

    for v in own.values():
        v.sort(key=lambda x: (*x[:3], md5(x[3].encode()).hexdigest()))
    built = {}
    for c, v in own.items():
        h = crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        built[c] = tuple((r, x) for _, _, r, x in own.get(base, [])[:h] + v[h:])
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    out = []
    for k, members in nodes.items():
        below = [j for j in nodes if j[: len(k)] == k]
        saved = sum((len(nodes[j]) - 1) * len(j[-1][1]) for j in below if j)
        ends = ",".join(map(str, sorted(c for c in members if built[c] == k)))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], sum(not kids[j] for j in below), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_equals_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 40), *range(100, 140), 205, 1000, -3, -150]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ß日", None, ""])) for t in range(rng.choice([1, 2, 3, 7]))]
    rows += [(300, t, "user", "long") for t in range(90)] + [(399 - k, t, "user", "long") for k in range(20) for t in range(70 + k)]
    rows += [(500, None, "user", "first"), (500, 3, "user", "z"), (500, 3, "user", "z"), (500, 3, None, "y"), (None, 0, "user", "no id"), (500, 1, "x" * 3, "t" * 50000)]
    table = spark.createDataFrame([(*r, "c", 7, "k", "p") for r in rows], "conv_id long, turn long, role string, text string, conv string, depth long, key string, parent string").repartition(3)
    for piece in (1 << 15, 12):
        got = prefix_trie(*with_borrowed_starts(*turn_rows(table)), piece=piece)
        assert sorted(map(tuple, got.collect()), key=repr) == trie(rows)
    assert prefix_trie(*with_borrowed_starts(*turn_rows(table.limit(0)))).count() == 0


@pytest.mark.parametrize("shape", ["random", "path", "star", "forest"])
def test_centroid_totals(shape):
    rng = random.Random(2)
    n = 400
    parent = [{"random": rng.randrange(i) if i else -1, "path": i - 1, "star": 0 if i else -1, "forest": rng.choice([-1, *range(i)]) if i % 9 else -1}[shape] for i in range(n)]
    values = np.array([[rng.randrange(9), 1] for _ in range(n)])
    want = values.copy()
    for i in reversed(range(n)):
        if parent[i] >= 0:
            want[parent[i]] += want[i]
    assert (centroid_totals(np.array(parent), values) == want).all()
    assert centroid_totals(np.zeros(0, np.int64), np.zeros((0, 2), np.int64)).shape == (0, 2)


@pytest.mark.parametrize("name", ["op11_vantage_trees", "op12_length_strata", "op13_centroid_trie"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(Q.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(want.fetchall(), key=repr) == sorted(map(tuple, Q.QUERIES[name](spark, SF).select(*names).collect()), key=repr)


# ---- shards ------------------------------------------------------------------------------------------------------------


def test_grammar_leaves_no_frequent_pair():
    from seriesloom.llm.repair import RePairSettings, Shard, compress, pack_shard

    rng = np.random.default_rng(1)
    s = RePairSettings(least=4)
    copies = [rng.integers(0, 50, 400)] * 600  # deep rules: far more than 256 ids each
    docs = [*copies, rng.integers(0, 50, 5000), np.zeros(999, int), np.zeros(0, int), np.array([7])]
    ids, bounds = np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    seq, begin, rules = compress(ids, bounds, 50, s)
    ends = set((begin[1:] - 1).tolist())
    pairs = Counter()
    run = None
    for i in range(len(seq) - 1):
        if i in ends:
            run = None
            continue
        p = (int(seq[i]), int(seq[i + 1]))
        if run != p or p[0] != p[1]:
            pairs[p] += 1
            run = p
        else:
            run = None
    assert max(pairs.values()) < s.least and len(seq) < 5000
    shard = Shard(pack_shard(np.arange(len(docs)), ids, bounds, 50, s))
    assert shard.lengths.max() == 400
    for k in (0, 599, 600, 601, 602, 603):
        assert np.array_equal(shard.read(k), docs[k])
    assert np.array_equal(shard.read(600, 1234, 2345), docs[600][1234:2345])


def test_shards_refuse_null_ids(spark, tmp_path):
    from seriesloom.llm.repair import write_shards

    table = spark.createDataFrame([(1, "a"), (None, "b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="doc_id"):
        write_shards(table, str(tmp_path / "shards"), Q.TOKENIZER)
    assert not (tmp_path / "shards").exists()


# ---- awkward ids -------------------------------------------------------------------------------------------------------


def test_contamination_is_told_row_by_row(spark):
    import corpus_pipeline as P
    from seriesloom.llm.decontam import mark_contaminated

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(2).collect()]
    rows = [(7, items[0]), (7, items[1]), (7, "a clean text of its own"), (None, "before " + items[0] + " after"), (8, None), (9, "clean too")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for block in (4_000_000, 100):
        got = mark_contaminated(docs.withColumn("item_ids", F.lit("old")), bench, block_chars=block)
        assert got.columns == [*docs.columns, "item_ids", "distances"]
        assert {r["text"]: r["item_ids"] for r in got.collect()} == {items[0]: [0], items[1]: [1], rows[2][1]: None, rows[3][1]: [0], None: None, "clean too": None}
    assert {r["text"] for r in P.decontaminate(spark, docs, SF).collect()} == {rows[2][1], None, "clean too"}


def test_near_dedup_keeps_one_row_of_an_id(spark):
    import corpus_pipeline as P

    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (1, text), (2, text), (3, "another one"), (None, "no id"), (3, "another one")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((str(r["doc_id"]), r["text"]) for r in P.near_dedup(spark, docs, SF).collect()) == [("1", text), ("3", "another one"), ("None", "no id")]


def test_conversations_with_string_ids(spark):
    from seriesloom.llm.chat import chat_windows, read_back

    turns = spark.createDataFrame([(c, t, r, f"{c} says {t}") for c in ("x", "y", None) for t, r in enumerate(("user", "assistant"))], "conv_id string, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in read_back(chat_windows(turns)).collect()}
    assert got == {"x": (2, 8), "y": (2, 8), None: (2, 11)}
