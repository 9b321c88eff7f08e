"""One registered query per operator, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import uuid
from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesloom.llm import ranked
from seriesloom.llm.bpe import bpe_decode, bpe_encode
from seriesloom.llm.chat import chat_windows, read_back
from seriesloom.llm.decontam import mark_contaminated
from seriesloom.llm.imatch import compare_edited, lexicon
from seriesloom.llm.langid import fit_languages, identify_languages
from seriesloom.llm.linedup import dedupe_lines
from seriesloom.llm.minhash import near_duplicates
from seriesloom.llm.pii import KINDS, personal_data, spans_text
from seriesloom.llm.quality import fit_quality, score_quality
from seriesloom.llm.repair import read_shards, write_shards
from seriesloom.llm.trie import prefix_trie, turn_rows, with_borrowed_starts
from seriesloom.llm.vptree import build_index, search
from seriesloom.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_SHINGLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY 1, 2, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.other),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1)
"""


@query("op2_near_duplicates", _SHINGLE_SQL + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents"))


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op4_repair_shards")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/shards-{uuid.uuid4().hex}"
    write_shards(_table(spark, sf, "documents"), folder, TOKENIZER)
    return read_shards(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_bpe_lexicon")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    both = bpe_decode(bpe_encode(_table(spark, sf, "documents"), TOKENIZER), TOKENIZER)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op1_imatch")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return compare_edited(docs, lexicon(docs, "text"))



@query("op3_chat_windows")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return read_back(chat_windows(turns))


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@query("op6_quality")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = fit_quality(docs, _table(spark, sf, "labels"), _remainder(3) != 1)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_language_id")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs, _remainder(4) != 2)
    return identify_languages(docs.drop("lang"), model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


_LINES_SQL = r"""
raw AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, unnest(range(len(parts))) AS line, trim(unnest(parts), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM raw),
cl AS (SELECT t, min((doc_id, line)) AS first, length(t) AS n FROM ln WHERE t <> '' GROUP BY t),
v AS (SELECT t, first, n, unnest(range(n)) AS i FROM cl WHERE n >= 16),
d AS (SELECT t, first, n, i, substr(t, 1, i) || substr(t, i + 2) AS x FROM v),
pairs AS (
  SELECT a.t, a.first, b.t AS u, b.first AS other FROM d a JOIN d b ON a.x = b.x AND a.i = b.i AND a.n = b.n AND a.t <> b.t
  UNION ALL SELECT a.t, a.first, c.t, c.first FROM d a JOIN cl c ON a.x = c.t WHERE c.n >= 16
  UNION ALL SELECT c.t, c.first, a.t, a.first FROM d a JOIN cl c ON a.x = c.t WHERE c.n >= 16),
near AS (SELECT DISTINCT t FROM pairs WHERE other < first AND levenshtein(t, u) <= 1),
gone AS (
  SELECT ln.doc_id, ln.line FROM ln JOIN cl USING (t) LEFT JOIN near USING (t)
  WHERE near.t IS NOT NULL OR cl.first <> (ln.doc_id, ln.line)),
g AS (SELECT doc_id, count(*) AS n_removed, list(line) AS lines FROM gone GROUP BY doc_id),
deduped AS (
  SELECT documents.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(g.n_removed, 0) AS n_removed,
    CASE WHEN g.lines IS NULL THEN text
      ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda p, k: NOT list_contains(g.lines, k - 1)), chr(10)) END AS text
  FROM documents LEFT JOIN g USING (doc_id))"""


@query("op5_line_dedup", f"WITH {_LINES_SQL} SELECT doc_id, n_lines, n_removed, sha256(coalesce(text, '')) AS text_sha256 FROM deduped")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    out = dedupe_lines(_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query("op9_decontamination")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, with the test items that they hold."""
    marked = mark_contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), keep=["doc_id"])
    n = F.size(F.coalesce("item_ids", F.array().cast("array<long>")))
    return marked.select("doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), "item_ids", "distances")


@query("op10_personal_data")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_data(_table(spark, sf, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    kinds = F.transform("base", lambda s: s["kind"])  # a second parameter of a lambda would be the place in the array
    counts = [F.size(F.filter(kinds, lambda kind: kind == F.lit(KINDS.index(name)))).cast("long").alias(f"n_{name}") for name in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


@query("op11_vantage_trees", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
ok AS (
  SELECT DISTINCT vec_id, v FROM e
  WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM ok q JOIN ok c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings")
    return search(build_index(vectors), vectors.where("vec_id % 20 = 0"), 20)


@query("op12_length_strata", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
dn AS (SELECT r, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM dn),
dm AS (SELECT r, doc_id, 100 - 50 + ((50 * n * nn) // ll) AS m FROM dn, g),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM dn) GROUP BY ALL),
it AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), g),
s AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM it JOIN tf USING (t) JOIN w USING (t) JOIN dm USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s JOIN dm USING (r) WHERE score > 0 QUALIFY rank <= 50""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    index, n_docs = ranked.build_index(_table(spark, sf, "documents"))
    return ranked.search(index, n_docs, _table(spark, sf, "benchmark"))


@query("op13_centroid_trie", """
WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM t),
-- crc32 of the decimal id, bit by bit
crc AS (SELECT c, xor(4294967295, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda a, b:
  list_reduce(list_transform(range(8), lambda z: z::BIGINT), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295::BIGINT)) % 6 AS h FROM ids),
got AS (
  SELECT crc.c, 0 AS part, t.i, role, text FROM crc JOIN t ON t.c = crc.c - crc.c % 100 AND t.i < crc.h
  UNION ALL SELECT crc.c, 1, t.i, role, text FROM crc JOIN t ON t.c = crc.c AND t.i >= crc.h),
reb AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, role, text FROM got),
n AS (SELECT ids.c, coalesce(max(d), 0) AS len FROM ids LEFT JOIN reb USING (c) GROUP BY ids.c),
path(c, d, k, p, chars) AS (
  SELECT c, 0::BIGINT, md5(''), NULL::VARCHAR, 0::BIGINT FROM ids
  UNION ALL SELECT r.c, r.d, md5(path.k || length(r.role)::VARCHAR || ':' || r.role || r.text), path.k, length(r.text)::BIGINT FROM path JOIN reb r ON r.c = path.c AND r.d = path.d + 1),
node AS (SELECT k, any_value(p) AS p, any_value(d) AS depth, min(path.c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
  coalesce(string_agg(path.c::VARCHAR, ',' ORDER BY path.c) FILTER (WHERE n.len = path.d), '') AS ends FROM path JOIN n ON n.c = path.c GROUP BY k),
kids AS (SELECT p, count(*) AS n_children FROM node GROUP BY p),
above(k, a) AS (SELECT k, k FROM node UNION ALL SELECT above.k, node.p FROM above JOIN node ON node.k = above.a WHERE node.p IS NOT NULL),
sub AS (SELECT a, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE kids.p IS NULL) AS n_leaves FROM above JOIN node USING (k) LEFT JOIN kids ON kids.p = above.k GROUP BY a)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n_children, 0) AS n_children, sub.n_leaves, sub.saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN sub ON sub.a = node.k LEFT JOIN node up ON up.k = node.p LEFT JOIN kids ON kids.p = node.k""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie(*with_borrowed_starts(*turn_rows(_table(spark, sf, "conversations"))))
