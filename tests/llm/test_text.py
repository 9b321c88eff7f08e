"""The text operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesloom.llm import queries as Q
from seriesloom.llm.bpe import bpe_decode, bpe_encode
from seriesloom.llm.chat import CONTROL, WindowSettings, chat_windows, escape, read_back, unescape
from seriesloom.llm.decontam import contaminated, least_distance, normal, pattern_masks
from seriesloom.llm.graph import components
from seriesloom.llm.imatch import compare_edited, edited_text, fingerprints, lexicon
from seriesloom.llm.langid import fit_languages, identify_languages
from seriesloom.llm.linedup import dedupe_lines
from seriesloom.llm.minhash import MinHashSettings, near_duplicates
from seriesloom.llm.pii import KINDS, personal_data
from seriesloom.llm.quality import fit_quality, score_quality
from seriesloom.llm.repair import RePairSettings, Shard, pack_shard, read_shards, write_shards

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \n\t ", "a", "Ünï çödé 日本語 ٣ 😀 don't <|endoftext|> x", "word " * 30000, "same text of six words here", "same text of six words here", "x\n\n\ny", "\x1d\x1e 　"]
SCHEMA = "doc_id long, text string, lang string, component_id string, score string, n_lines string, fingerprint string"


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "c", "s", "n", "f") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- links -----------------------------------------------------------------------------------------------------------


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 430)] + [(5, 5)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect())
    want = roots({n for e in links for n in e}, links)
    assert {k: v for k, v in want.items() if k != v} == {k: v for k, v in got.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[ \t-\r]+", lower) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(texts, percent=85):
    sets = [shingles(t) for t in texts]
    links = []
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    root = roots(range(len(sets)), links)
    return sorted((k, len(s), root[k], root[k] == k) for k, s in enumerate(sets))


@pytest.mark.parametrize("settings", [MinHashSettings(), MinHashSettings(small=4, block=40)])
def test_near_duplicates(spark, settings):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = list(ODD)
    for _ in range(220):  # copies with up to five edits: some are linked, some are not
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5])):
            w[rng.randrange(150)] = f"x{rng.randrange(99999)}"
        texts.append(" ".join(w))
    assert rows(near_duplicates(table(spark, texts), settings=settings)) == sorted(brute_near(texts), key=repr)


def test_near_duplicates_odd_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert rows(near_duplicates(docs)) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert near_duplicates(docs.limit(0)).count() == 0


# ---- fingerprints ----------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    terms = lexicon(docs, "text")
    texts = [t for _, t in sorted((r[0], r[1]) for r in docs.select("doc_id", "text").collect())][:60] + ODD
    got = compare_edited(table(spark, texts), terms).orderBy("doc_id").collect()
    for k, r in enumerate(got):
        text = texts[k] or ""
        edited = edited_text(text, texts[(k + 1) % len(texts)] or "")
        n = len(text) // 4
        assert edited == text[: len(text) - n] + (texts[(k + 1) % len(texts)] or "")[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    for k, r in enumerate(got):
        assert by_text.setdefault(texts[k] or "", r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
    first = got[:60]
    assert np.mean([r.near_edited for r in first]) > 0.4 and np.mean([r.near_next for r in first]) < 0.1
    plain = dict(tuple(r) for r in fingerprints(table(spark, texts), terms).collect())
    assert all(plain[k] == r.fingerprint for k, r in enumerate(got))
    assert compare_edited(table(spark, texts).limit(0), terms).count() == 0
    one = compare_edited(table(spark, ["a lone text"]), terms).first()
    assert one.near_next == 1.0


def test_fingerprints_of_a_hot_group(spark):
    """A third of the rows are copies and near copies of one text."""
    rng = random.Random(8)
    plain = [" ".join(f"v{rng.randrange(3000)}" for _ in range(80)) for _ in range(400)]
    base = [f"h{k}" for k in range(160)]
    near = []
    for _ in range(100):
        w = list(base)
        for k in rng.sample(range(160), 4):
            w[k] = f"v{rng.randrange(3000)}"
        near.append(" ".join(w))
    hot = [" ".join(base)] * 100 + near
    texts = [x for k in range(100) for x in (hot[k], plain[4 * k], near[k], near[(k + 1) % 100], *plain[4 * k + 1 : 4 * k + 4])]
    docs = table(spark, texts)
    got = compare_edited(docs, lexicon(docs, "text")).orderBy("doc_id").collect()

    def common(x, y):
        x, y = set(x.split()), set(y.split())
        return len(x & y) / len(x | y)

    assert not [r for r in got if r.fingerprint[0] == "t"]
    for kind in (0, 2, 3):  # a copy, a near copy before another one, a near copy before another text
        of = range(kind, len(texts), 7)
        edited = [common(texts[k], edited_text(texts[k], texts[(k + 1) % len(texts)])) for k in of]
        assert abs(np.mean([got[k].near_edited for k in of]) - np.mean(edited)) < 0.1 and min(got[k].near_edited for k in of) > 0.2
    assert min(got[k].near_next for k in range(2, len(texts), 7)) > 0.6
    assert max(got[k].near_next for k in range(4, len(texts), 7)) < 0.3


# ---- chat ------------------------------------------------------------------------------------------------------------

CHAT_SQL = """
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM u GROUP BY conv_id"""


def test_escape_is_reversible():
    rng = random.Random(3)
    parts = ["<", "|", ">", "\\", "[INST]", "</s>", "<s>", "/", "s", "<|", "|>", "<|/turn|>", "\n", "a", "<<SYS>>", "[", "INST]"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(10)))
        assert unescape(escape(t)) == t and not any(c in escape(t) for c in CONTROL)


def test_chat_windows(spark):
    rng = random.Random(4)
    turns = [(1, 0, "system", "be brief"), (2, 0, None, None), (3, 0, "assistant", "x " * 3000), (3, 1, "end", "</s>\\"), (4, 0, "system", "only"), (None, 0, "user", "lost")]
    for t in range(60):
        turns.append((1, t + 1, "user" if t % 2 == 0 else "assistant", " ".join(rng.choice(["a", "|>", "é", "[INST]"]) for _ in range(rng.randrange(16)))))
    turns += [(5, 1, "assistant", "twice")] * 2
    df = spark.createDataFrame([(*t, "w") for t in turns], "conv_id long, turn long, role string, text string, window string")
    s = WindowSettings(budget=100, history_turns=2, history_tokens=40)
    windows = chat_windows(df, settings=s)
    held = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(held) > 5 and all(w.n_tokens <= 100 for w in held) and all("be brief" in w.text for w in held)
    assert any(w.n_repeated > 1 for w in held[1:])
    got = read_back(windows).drop("formatted_chars").toPandas()
    con = duckdb.connect()
    u = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).toPandas()  # noqa: F841
    want = con.execute(CHAT_SQL).df()
    key = lambda f: sorted(map(str, f.astype(object).where(f.notna(), None)[sorted(f.columns)].values.tolist()))
    assert [x.replace(".0", "") for x in key(got)] == [x.replace(".0", "") for x in key(want)]
    assert chat_windows(df.limit(0)).count() == 0


# ---- tokens ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(Q.TOKENIZER)


def awkward():
    rng = random.Random(5)
    parts = ["don't", "it's", " 'll", "''s", "'s", " '", "\n", "\n\n", "  ", "   ", "\t", " a", "1", "23", "²", "é", "×", "日本", "'re'", "!!?", " !x", "<|endoftext|>", "\x1d", " ", "aaaaaaa", "'LL", "x_y", "ﬁ", "٣"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)] + ODD


def test_bpe(spark, library):
    texts = awkward()
    both = bpe_decode(bpe_encode(table(spark, texts), Q.TOKENIZER, lexicon_size=300), Q.TOKENIZER).collect()
    assert len(both) == len(texts)
    for r in both:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.text == library.decode(ids, skip_special_tokens=False)
    assert bpe_encode(table(spark, texts).limit(0), Q.TOKENIZER).count() == 0


def test_repair_random_access():
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 12, n).astype(np.uint32) for n in (0, 1, 900, 3, 5000, 0)] + [np.full(777, 4, np.uint32), np.tile(np.array([1, 2], np.uint32), 500)]
    ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([p.size for p in parts])])
    shard = Shard(pack_shard(np.arange(len(parts)), ids, bounds, 50257, RePairSettings()))
    back, begin = shard.read_all()
    assert (back == ids).all() and (begin == bounds).all() and len(shard.rules) and shard.symbols.size < 0.6 * ids.size
    for k, p in enumerate(parts):
        assert (shard.read(k) == p).all()
        for _ in range(20):
            a, b = sorted(rng.integers(0, p.size + 2, 2).tolist())
            assert (shard.read(k, a, b) == p[a:b]).all()


def test_repair_shards(spark, library, tmp_path):
    texts = awkward()
    folder = str(tmp_path / "shards")
    write_shards(table(spark, texts), folder, Q.TOKENIZER, settings=RePairSettings(shard_tokens=2000, least=4))
    start = 0
    for r in read_shards(spark, folder).orderBy("doc_id").collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens) == (start, len(want)) and np.frombuffer(bytes(r.ids), "<u4").tolist() == want
        start += len(want)
    write_shards(table(spark, texts).limit(0), folder + "-none", Q.TOKENIZER)
    assert read_shards(spark, folder + "-none").count() == 0


def test_token_queries(spark, library):
    docs = sorted((r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    four, seven, start = [], [], 0
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        seven.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        four.append((i, start, len(ids) + 1, zlib.crc32(raw + np.array([2], "<u4").tobytes())))
        start += len(ids) + 1
    assert sorted(map(tuple, Q.op7(spark, SF).collect())) == seven
    assert sorted(map(tuple, Q.op4(spark, SF).collect())) == four


# ---- lines -----------------------------------------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :]


def brute_lines(texts):
    seen, out = {}, []
    for t in texts:
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            s = line.strip(" \t\v\f\r")
            if s and (s in seen or (len(s) >= 16 and any(len(o) >= 16 and near(s, o) for o in seen))):
                gone += 1
            else:
                kept.append(line)
            if s:
                seen.setdefault(s, 1)
        out.append((None if t is None else "\n".join(kept) if gone else t, 0 if t is None else t.count("\n") + 1, gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(7)
    pool = ["".join(rng.choice("abcdé 😀") for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["item number 1 of the list", "", "  "]

    def edit(s):
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k, kind = rng.randrange(len(s) + 1), rng.randrange(3)
            s = s[:k] + ("" if kind == 0 else rng.choice("xyé😀0123456789")) + s[k + (kind != 1) :]
        return s

    texts = list(ODD) + ["\n".join(rng.choice(["", " ", "\t"]) + edit(rng.choice(pool)) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedupe_lines(table(spark, texts)).collect()}
    want = brute_lines(texts)
    assert sum(w[2] for w in want) > 300
    for k, w in enumerate(want):
        assert got[k] == w, texts[k]
    assert dedupe_lines(table(spark, texts).limit(0)).count() == 0


def test_line_dedup_of_a_very_long_document(spark):
    """Work is in proportion to the lines, however many of them go."""
    many = 300_000
    docs = spark.createDataFrame([(1, "one and the same line, again and again\n" * many + "the end of it all"), (2, "the end of it all\nanother line")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedupe_lines(docs).collect()}
    assert got == {1: ("one and the same line, again and again\nthe end of it all", many + 1, many - 1), 2: ("another line", 2, 1)}


# ---- models ----------------------------------------------------------------------------------------------------------


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = fit_languages(docs, ~held)
    got = identify_languages(docs.where(held).select("doc_id", "text", "lang"), model).where("lang IS NOT NULL").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    odd = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(table(spark, ODD + ["123 !?"]), model).collect()}
    assert [odd[k][0] for k in (0, 1, 2, len(ODD))] == ["und"] * 4 and odd[3][0] != "und"
    none = fit_languages(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in identify_languages(table(spark, ODD), none).collect()} == {"und"}


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = fit_quality(docs, labels, ~held)
    got = score_quality(docs.select("doc_id", "text").join(labels.where(held), "doc_id"), model).toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.97
    odd = score_quality(table(spark, ODD), model).toPandas()
    assert len(odd) == len(ODD) and odd.score.between(0, 1).all()
    none = fit_quality(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in score_quality(table(spark, ODD), none).collect()} == {0.5}


# ---- benchmark and personal data ---------------------------------------------------------------------------------------


def brute_distance(pattern, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        now = [i + 1]
        for j, d in enumerate(text):
            now.append(min(prev[j] + (c != d), prev[j + 1] + 1, now[j] + 1))
        prev = now
    return min(prev)


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aehinorst") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(rng.randrange(6, 16))) for _ in range(25)]
    for _ in range(300):
        p, t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 70))), "".join(rng.choice("abc") for _ in range(rng.randrange(90)))
        assert least_distance(pattern_masks(p), len(p), t, -1) == brute_distance(p, t)
    texts = list(ODD)
    for _ in range(120):
        item = list(rng.choice(items))
        for _ in range(rng.randrange(0, 12)):
            k, kind = rng.randrange(len(item)), rng.randrange(3)
            item[k : k + (kind != 1)] = [] if kind == 0 else [rng.choice("xyz")]
        texts.append(f"{word()}  {word().upper()}\n{''.join(item).title()} {word()}")
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(90, None, "x"), (91, "", "x"), (None, "a", "x")], "item_id long, text string, doc_id string")
    want = {}
    for i, t in enumerate(texts):
        if t and len(t) < 10000:
            hits = {k for k, x in enumerate(items) if brute_distance(normal(x), normal(t)) <= int(len(normal(x)) * 0.1)}
            if hits:
                want[i] = hits
    assert 30 < len(want) < 120
    for size in (4_000_000, 400):
        assert {r.doc_id: set(r.item_ids) for r in contaminated(table(spark, texts), bench, block_chars=size).collect()} == want
    assert contaminated(table(spark, texts), bench.limit(0)).count() == 0 and contaminated(table(spark, texts).limit(0), bench).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark):
    rng = random.Random(9)
    parts = ["a", "b.c", "@", "x@y.z", ".", "..", "+", "-", " ", "1", "12", "4111111111111111", "4111 1111 1111 1111", "255", "256", "1.2.3.4", ".5.6.7.8", "0255.1.1.1", "+1 (543) 555-9258", "+49", "(", ")", "é", "😀", "", "a@b.c+d@e.f", "%", "_", "password=9024a2d3a685958c46"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500)] + ODD + ["1 " * 20000, "+1" * 20000, "1.2" * 2000]
    long_ones = ["a" * 100000, "a." * 50000 + "@b" + ".c" * 50000, "1" * 100000]
    got = {r.doc_id: r.spans for r in personal_data(table(spark, texts + long_ones)).collect()}
    for k, t in enumerate(texts):
        assert [(KINDS[s.kind], s.start, s.stop) for s in got[k] if s.base] == brute_base(t or ""), t
    assert len(got[len(texts) + 1]) == 1
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [r for r in personal_data(docs).join(docs, "doc_id").select("text", F.explode("spans").alias("s")).where("NOT s.base").collect()]
    assert all(KINDS[r.s.kind] == "secret" for r in extra)
    assert personal_data(docs.limit(0)).count() == 0


def test_personal_data_counts_by_kind(spark, tmp_path):
    from seriesloom.llm.queries import QUERIES

    texts = ["a@b.c", "1.2.3.4", "4111111111111111 and +1 (543) 555-9258", "x@y.z u@v.w 1.2.3.4 4111111111111111 +1 543 555 9258", "+49 151 2345678 a@b.c", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op10_personal_data"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        base = brute_base(t or "")
        assert [got[k][f"n_{kind}"] for kind in KINDS[:4]] == [sum(s[0] == kind for s in base) for kind in KINDS[:4]], t
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base).encode()).hexdigest(), t


# ---- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_has_one_python_operator_a_task(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "some words", "en", "x", 10), (2, None, "en", "x", None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.tokens(spark, docs, SF)
    assert out._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    assert {r.doc_id: r.n_tokens > 0 for r in out.collect()} == {1: True, 2: False}


def test_links_are_confirmed_on_their_own_texts_only(spark):
    from seriesloom.llm.minhash import MinHashSettings, _verified

    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c d e f", "a b c d e f", "u v w x y z", "p q r s t u"])], "id long, text string")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (2, 0)], "a long, b long")
    out = _verified(pairs, docs, MinHashSettings())
    assert out._jdf.queryExecution().analyzed().toString().count("_jk_id") > 0
    assert [tuple(r) for r in out.collect()] == [(1, 0)]


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(90001, None, None, None, None), (90002, "12 34", "en", "x", 5), (90003, "", "en", "x", 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    held = {r.doc_id: r.text for r in docs.collect()}
    step = P.language(spark, docs, SF)
    assert step.columns == list(P.COLUMNS) and set(held) - {r.doc_id for r in step.collect()} == {90001, 90002, 90003}
    docs = docs.where("doc_id < 90000")
    order = sorted(r.doc_id for r in docs.collect())
    want = {i: t for i, (t, _, n) in zip(order, brute_lines([held[i] for i in order])) if not n or t.strip(" \t\r\n\v\f")}
    lined = P.line_dedup(spark, docs, SF)
    assert {r.doc_id: (r.text, r.n_chars) for r in lined.collect()} == {i: (t, len(t)) for i, t in want.items()}
    order = sorted(want)
    kept = {order[k] for k, _, _, keep in brute_near([want[i] for i in order]) if keep}
    near = P.near_dedup(spark, lined, SF)
    assert {r.doc_id for r in near.collect()} == kept
    items = [normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in P.decontaminate(spark, near, SF).collect()}
    assert left == {i for i in kept if not any(x in normal(want[i]) for x in items)}
    done = {r.doc_id for r in P.run(spark, SF).collect()}
    assert done == left


def test_pipeline_near_dedup_at_80_percent(spark):
    import corpus_pipeline as P

    rng = random.Random(11)
    texts, want = [], set()
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(149 if g < 6 else 200)]
        texts.append(" ".join(base))
        want.add(len(texts) - 1)
        for edits, at in ((3, (20, 70, 120)), (4, (20, 60, 100, 130))):
            w = list(base)
            for k in at:
                w[k] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(w))
            both, union = len(shingles(texts[-1]) & shingles(" ".join(base))), len(shingles(texts[-1]) | shingles(" ".join(base)))
            if 100 * both < 80 * union:
                want.add(len(texts) - 1)
    near = [f"s{k}" for k in range(184)]  # 180 runs of five words, 160 of them common: exactly 80 percent
    texts += [" ".join(near), " ".join(near[:20] + ["y"] + near[21:60] + ["y1"] + near[61:100] + ["y2"] + near[101:140] + ["y3"] + near[141:])]
    both = len(shingles(texts[-1]) & shingles(texts[-2]))
    assert 100 * both == 80 * (360 - both)
    want.add(len(texts) - 2)
    docs = table(spark, texts).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    assert {r.doc_id for r in P.near_dedup(spark, docs, SF).collect()} == want
    assert len({r.doc_id for r in near_duplicates(docs).where("kept").collect()}) > len(want)


def test_pipeline_rejects_unlearned_text(spark):
    """Foreign and junk documents go whatever the number of learned languages; passages in two of them stay."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {lang: [r.text for r in docs.where((F.col("lang") == lang) & (F.length("text") > 300)).orderBy("doc_id").limit(6).collect()] for lang in ("de", "en", "es", "fr")}
    rng = random.Random(12)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") if rng.random() < 0.85 else " " for _ in range(300)) for _ in range(5)]
    foreign = ["Это простой текст на русском языке, он говорит о погоде и о городе", "日本語の文章です。今日は天気がいいですね", "字", "Αυτό είναι ένα απλό κείμενο στα ελληνικά για τον καιρό",
               "Śnieg przykrył całą wieś, więc chłopcy wzięli łyżwy i poszli nad zamarznięty staw"]
    for langs in (["en"], ["de", "en"], ["de", "en", "es", "fr"]):
        mixed = [a + "\n" + b for a, b in zip(text[langs[0]], text[langs[-1]])]
        bad = [(80000 + k, t, None) for k, t in enumerate(foreign)] + [(81000 + k, t, "en") for k, t in enumerate(junk)]
        extra = spark.createDataFrame([(i, t, lang, "x", len(t)) for i, t, lang in bad + [(82000 + k, t, None) for k, t in enumerate(mixed)]], docs.schema)
        held = docs.where(F.col("lang").isin(langs))
        kept = {r.doc_id for r in P.language(spark, held.union(extra), SF).collect()}
        assert kept == {r.doc_id for r in held.where("text rlike '\\\\p{L}'").collect()} | {82000 + k for k in range(len(mixed))}
