"""Quality scores from supervised subword embeddings: hashed word and character n-gram vectors, averaged per document."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seriesloom.llm.ngrams import Sparse, code_points, ngrams, row_counts, row_sums, score_texts, softmax, train_in_task
from seriesloom.llm.words import text_slices, word_hashes


@dataclass(frozen=True)
class QualitySettings:
    """About ``per_class`` rows of every class are fitted, chosen by a hash of the id (all if there are fewer).

    ``bits`` is the logarithm of the number of vectors for each kind of feature, ``dim`` their length.
    """

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    dim: int = 8
    per_class: int = 2000
    epochs: int = 12
    batch: int = 32
    rate: float = 0.5
    reach: float = 60.0


def _features(data: np.ndarray, offsets: np.ndarray, s: QualitySettings):
    """Words as they are written, pairs of a word and whether the next one is the same, and character n-grams of every order."""
    words, first = word_hashes(data, offsets, lower=False)
    size = np.diff(first)
    again = np.zeros(words.size, np.int64)
    again[:-1] = words[1:] == words[:-1]
    ends = first[1:][size > 0] - 1
    again[ends] = 2
    parts = [((words >> np.uint64(64 - s.bits)).astype(np.int64), first[:-1], size), (again + (1 << s.bits), first[:-1], size)]
    cps, at = code_points(data, offsets)
    for k, order in enumerate(s.orders):
        h, begin, n = ngrams(cps, at, order, s.bits)
        parts.append((h + ((k + 2) << s.bits), begin, n))
    return parts


def _fit(rows: list[dict], s: QualitySettings) -> bytes:
    labels = sorted({r["label"] for r in rows})
    if len(labels) < 2:
        return pickle.dumps((None, float(labels[0]) if labels else 0.5))
    rows = sorted(rows, key=lambda r: (r["draw"], r["text"]))
    # Every kind of feature has the same weight in a document's mean vector.
    vectors = []
    for _, _, d, o in text_slices(pa.array([r["text"] for r in rows], pa.large_string()), 1 << 20):
        kinds = [row_counts([part]) for part in _features(d, o, s)]
        for k in range(o.size - 1):
            vectors.append((np.concatenate([c[k][0] for c in kinds]), np.concatenate([c[k][1] / max(c[k][1].sum(), 1) / len(kinds) for c in kinds])))
    x, y = Sparse(vectors), np.array([labels.index(r["label"]) for r in rows])
    width, k = (len(s.orders) + 2) << s.bits, len(labels)
    rng = np.random.default_rng(11)
    embedding = rng.uniform(-1, 1, (width, s.dim)) / s.dim
    out, bias = rng.uniform(-1, 1, (s.dim, k)) / s.dim, np.zeros(k)
    steps = s.epochs * -(-len(rows) // s.batch)
    step = 0
    for _ in range(s.epochs):
        for now in np.array_split(rng.permutation(len(rows)), -(-len(rows) // s.batch)):
            rate = s.rate * (1 - step / steps)
            step += 1
            b = x.take(now)
            used, b.feature = np.unique(b.feature, return_inverse=True)
            hidden = b.dot(embedding[used])
            error = softmax(hidden @ out + bias)
            error[np.arange(now.size), y[now]] -= 1
            error /= now.size
            back = error @ out.T
            out -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0)
            embedding[used] -= rate * s.reach * b.t_dot(back, used.size)
    # The softmax of a mean is a function of means of numbers: one number per feature and class is all that scoring needs.
    return pickle.dumps((labels, (embedding @ out).astype(np.float32), bias))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: QualitySettings = QualitySettings()) -> bytes:
    """A model from the texts of labelled rows; ``learn`` is a condition on the rows of ``labels``. NULL ids and labels are left out."""
    s = settings
    marks = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.withColumn("draw", F.xxhash64(F.col("id").cast("string"), F.lit("quality")))
    count = {r["label"]: r["count"] for r in marks.groupBy("label").count().orderBy(F.desc("count")).limit(100).collect()}
    chance = F.lit(0.0)
    for label, n in count.items():
        chance = F.when(F.col("label") == label, min(1.0, s.per_class / n)).otherwise(chance)
    chosen = marks.where(F.pmod("draw", F.lit(1 << 20)) < chance * (1 << 20))  # about per_class rows of each class: small enough to broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return train_in_task(texts.join(F.broadcast(chosen), "id").select("draw", "label", "text"), lambda r: _fit(r, s))


def score_quality(docs: DataFrame, model: bytes, text_col: str = "text", settings: QualitySettings = QualitySettings()) -> DataFrame:
    """All columns but the text, and score: the probability of the largest label for every row's whole text.

    NULL counts as the empty text, whose score is that of a mean vector of zeros. With one class or none to learn from, every score is that class (0.5). An
    empty table gives an empty one.
    """
    shared, s = docs.sparkSession.sparkContext.broadcast(model), settings
    held = {}

    def score(data, offsets):
        if "model" not in held:
            held["model"] = pickle.loads(shared.value)
        if held["model"][0] is None:
            return [np.full(offsets.size - 1, min(max(held["model"][1], 0.0), 1.0))]
        _, weights, bias = held["model"]
        parts = _features(data, offsets, s)
        logits = bias + sum(row_sums(weights[h], begin, n) / np.maximum(n, 1)[:, None] for h, begin, n in parts) / len(parts)
        return [softmax(logits)[:, -1]]

    return score_texts(docs.drop("score"), text_col, [T.StructField("score", T.DoubleType())], score)
