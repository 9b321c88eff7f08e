"""Training-corpus pipeline over the table documents: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesloom.llm.bpe import bpe_decode, bpe_encode
from seriesloom.llm.decontam import mark_contaminated
from seriesloom.llm.langid import UNDETERMINED, fit_languages, identify_languages
from seriesloom.llm.linedup import dedupe_lines
from seriesloom.llm.minhash import MinHashSettings, near_duplicates
from seriesloom.operators.joins import keyed_join
from seriesloom.session import ensure_checkpoint_dir, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text of which a smaller share of n-grams was seen in training is in none of the learned languages, or junk. Passages in two of them keep the share high.
LEAST_SEEN = 0.8
#: A pair at exactly 80 percent shares no band with probability 3e-6; 77 of 96 coordinates are expected to agree, 50 lie almost seven deviations below.
NEAR = MinHashSettings(percent=80, agree=50)
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _like_documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; lang becomes the prediction. NULL texts, texts without a letter and texts unlike those learned from go."""
    model = fit_languages(docs, F.lit(True))
    seen = identify_languages(docs.withColumn("_text", F.col("text")), model, "_text", seen_col="_seen")
    kept = seen.where((F.col("lang_pred") != UNDETERMINED) & (F.col("_seen") >= LEAST_SEEN))
    return _like_documents(kept.withColumn("lang", F.col("lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines out that repeat earlier ones; a document goes if nothing but white space is left of it. n_chars is counted anew."""
    clean = dedupe_lines(docs.select(*COLUMNS))
    clean = clean.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _like_documents(clean.withColumn("n_chars", F.length("text").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (``NEAR``: 80 percent of runs of five words) stays: the one with the smallest id, in one row. Rows without an id can't be grouped and stay."""
    gone = near_duplicates(docs, settings=NEAR).where(~F.col("kept")).select("doc_id").distinct()
    left = _like_documents(docs.join(gone, "doc_id", "left_anti"))
    # Rows of one id are one document, of which one row stays; only the rows of such ids are looked at again.
    again = materialize(left.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1"))
    marked = keyed_join(left, again, ["doc_id"])
    return marked.where("_rows IS NULL").drop("_rows").unionByName(marked.where("_rows > 1").drop("_rows").dropDuplicates(["doc_id"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of the benchmark go, row by row: a repeated or NULL id shields none and accuses none."""
    marked = mark_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return _like_documents(marked.where("item_ids IS NULL"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left."""
    # Written in between: a task that encodes and decodes at once keeps two Python workers, and idle ones hold their memory in the stages that follow.
    both = bpe_decode(materialize(bpe_encode(docs, TOKENIZER), "zstd"), TOKENIZER)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokens", tokens)]

#: Language models and tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a written table between two of them."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
