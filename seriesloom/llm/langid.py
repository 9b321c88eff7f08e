"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seriesloom.llm.ngrams import Sparse, code_points, letters, lowered, ngrams, row_counts, row_sums, score_texts, softmax, train_in_task
from seriesloom.llm.words import text_slices


@dataclass(frozen=True)
class LanguageSettings:
    """About ``per_language`` rows of every language are fitted, chosen by a hash of the id (all if there are fewer).

    Follow-the-regularised-leader with step ``alpha``, ``beta`` and the elastic-net penalties ``l1`` and ``l2``. A fifth of the rows sets
    the temperature instead. n-grams count as seen if two of a language's fitted texts hold them (one, for a language of fewer than 20
    texts), and are told apart by ``seen_bits`` bits.
    """

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    per_language: int = 800
    max_languages: int = 400
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    epochs: int = 3
    batch: int = 32
    seen_bits: int = 24


UNDETERMINED = "und"


def _spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased letters, every run of other characters being one blank; the rows' offsets; and how many letters each row has."""
    cps, at = code_points(data, offsets)
    letter = letters()[cps]
    cps = np.where(letter, lowered()[cps], np.uint32(32))
    first = np.zeros(cps.size + 1, bool)
    first[at] = True
    keep = letter | first[:-1]
    keep[1:] |= letter[:-1]
    total = np.concatenate([[0], np.cumsum(keep)])
    found = np.concatenate([[0], np.cumsum(letter)])
    return cps[keep], total[at], found[at[1:]] - found[at[:-1]]


def _grams(cps: np.ndarray, at: np.ndarray, s: LanguageSettings):
    parts = []
    for k, order in enumerate(s.orders):
        h, begin, size = ngrams(cps, at, order, s.bits)
        parts.append((h + (k << s.bits), begin, size))
    return parts


def _seen(rows: list[dict], labels: list[str], s: LanguageSettings) -> np.ndarray:
    """Which n-grams of any order the texts of a language have in common, as bits. Copies of a text are one text."""
    import pyarrow as pa

    seen = np.zeros(1 << s.seen_bits, bool)
    for label in labels:
        texts = sorted({r["text"] for r in rows if r["label"] == label})
        once, twice = np.zeros(seen.size, bool), np.zeros(seen.size, bool)
        for _, _, d, o in text_slices(pa.array(texts, pa.large_string()), 1 << 20):
            cps, at, _ = _spelled(d, o)
            for order in s.orders:
                h, begin, size = ngrams(cps, at, order, s.seen_bits)
                for b, z in zip(begin.tolist(), size.tolist()):
                    own = np.unique(h[b : b + z])
                    twice[own[once[own]]] = True
                    once[own] = True
        seen |= once if len(texts) < 20 else twice
    return np.packbits(seen)


def _fit(rows: list[dict], s: LanguageSettings) -> bytes:
    labels = sorted({r["label"] for r in rows})
    if not labels:
        return pickle.dumps(None)
    # Text and label only; whole texts; in an order that a hash of the id gives, so no order of arrival matters.
    rows = sorted(rows, key=lambda r: (r["draw"], r["text"]))
    import pyarrow as pa

    counts = [c for _, _, d, o in text_slices(pa.array([r["text"] for r in rows], pa.large_string()), 1 << 20) for c in row_counts(_grams(*_spelled(d, o)[:2], s))]
    y = np.array([labels.index(r["label"]) for r in rows])
    width = len(s.orders) << s.bits
    df = np.zeros(width)
    for f, _ in counts:
        df[f] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    x = Sparse([(f, 100 * n / max(n.sum(), 1) * idf[f]) for f, n in counts])
    held = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~held) if len(rows) >= 10 else np.arange(len(rows))
    check = np.flatnonzero(held) if len(rows) >= 10 else fit
    k = len(labels)
    z, n, bias = np.zeros((width, k)), np.zeros((width, k)), np.zeros(k)

    def weights(z, n):
        return np.where(np.abs(z) > s.l1, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2), 0.0)

    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        for rows_now in np.array_split(rng.permutation(fit), -(-len(fit) // s.batch)):
            b = x.take(rows_now)
            used, b.feature = np.unique(b.feature, return_inverse=True)
            w = weights(z[used], n[used])
            error = softmax(b.dot(w) + bias)
            error[np.arange(rows_now.size), y[rows_now]] -= 1
            g = b.t_dot(error, used.size) / rows_now.size
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / s.alpha
            z[used] += g - sigma * w
            n[used] += g * g
            bias -= 0.1 * error.mean(axis=0)
    w = weights(z, n)
    logits = x.take(check).dot(w) + bias
    rows_at = np.arange(check.size)
    heat = min(np.geomspace(0.25, 20, 121), key=lambda t: -np.log(np.maximum(softmax(logits / t)[rows_at, y[check]], 1e-12)).sum())
    return pickle.dumps((labels, (100 * idf[:, None] * w / heat).astype(np.float32), bias / heat, _seen(rows, labels, s)))


def fit_languages(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: LanguageSettings = LanguageSettings()) -> bytes:
    """A model from the texts and languages of rows where ``learn`` holds and neither is NULL."""
    s = settings
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string"), F.lit("lang")).alias("draw"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    count = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(s.max_languages).collect()
    share = {r["label"]: min(1.0, s.per_language / r["count"]) for r in count}
    chance = F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col("label")) if share else F.lit(0.0)
    sample = rows.where(F.pmod("draw", F.lit(1 << 20)) < F.coalesce(chance, F.lit(0.0)) * (1 << 20))
    return train_in_task(sample, lambda r: _fit(r, s))


def identify_languages(docs: DataFrame, model: bytes, text_col: str = "text", settings: LanguageSettings = LanguageSettings(), seen_col: str | None = None) -> DataFrame:
    """All columns but the text, and lang_pred and score of every row's whole text.

    The score is the calibrated probability of lang_pred. ``seen_col`` names a further column: the share of the text's n-grams that were seen in training, which
    tells texts in none of the learned languages, however many those are. Texts that are NULL or have no letter get ``und`` with the score 0, as does every text if there was
    nothing to learn from. An empty table gives an empty one.
    """
    shared, s = docs.sparkSession.sparkContext.broadcast(model), settings
    held = {}

    def score(data, offsets):
        if "model" not in held:
            held["model"] = pickle.loads(shared.value)
        rows = offsets.size - 1
        if held["model"] is None:
            return [[UNDETERMINED] * rows, np.zeros(rows)] + [np.zeros(rows)] * len(shares)
        labels, weights, bias, seen = held["model"]
        cps, at, found = _spelled(data, offsets)
        parts = _grams(cps, at, s)
        total = sum(size for _, _, size in parts)
        logits = sum(row_sums(weights[h], begin, size) for h, begin, size in parts) / np.maximum(total, 1)[:, None] + bias
        p = softmax(logits)
        best = p.argmax(axis=1)
        known = found > 0
        out = [[labels[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), known.tolist())], np.where(known, p[np.arange(rows), best], 0.0)]
        if shares:
            if "seen" not in held:
                held["seen"] = np.unpackbits(seen)
            hits = sum(row_sums(held["seen"][h].astype(np.int64), begin, size) for h, begin, size in (ngrams(cps, at, order, s.seen_bits) for order in s.orders))
            out.append(np.where(known, hits / np.maximum(total, 1), 0.0))
        return out

    shares = [T.StructField(seen_col, T.DoubleType())] if seen_col else []
    clash = [c for c in ("lang_pred", "score", seen_col) if c in docs.columns]
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + shares
    return score_texts(docs.drop(*clash), text_col, fields, score)
