"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader and elastic-net
penalties, then calibrated with one temperature.

Document frequencies are counted over all documents that may be learned from:
every task sums its own, and only one count per hashed n-gram leaves it.  The
weights are fitted on a bounded sample of them, drawn within each language in
turn, so that a rare language is learned like a frequent one.

Edge cases: null texts and texts without a letter are ``und`` with score 0; with
nothing to learn from, every text is ``und``; a null lang is never learned;
repeated rows are predicted alike; only doc_id, text and (to learn) lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import fold, fold_column, gathered, slices

#: Most documents that the fit reads, of all languages and of one.
MAX_TRAIN_ROWS = 3_000
MAX_LANG_ROWS = 1_000
#: Languages whose size reaches the tasks, the largest first.
MAX_SIZES = 10_000
HELD_OUT_OF = 5
ROWS = 1 << 14
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def gram_counts(text: str, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-character grams of the lower-cased text and their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keys = []
    value = np.zeros(len(points), np.uint32)
    for n, factor in enumerate(_FACTORS, 1):
        if len(points) < n:
            break
        value = value[:len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1:]
        mixed = (value ^ (value >> np.uint32(15))) * factor
        keys.append((mixed ^ (mixed >> np.uint32(13))) % np.uint32(rows))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0)
    count = np.bincount(np.concatenate(keys), minlength=rows)
    ids = np.flatnonzero(count)
    return ids, count[ids].astype(float)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray  # rows x languages
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[ids]
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return UNKNOWN, 0.0
        ids, count = gram_counts(text, len(self.idf))
        z = (self.features(ids, count) @ self.weights[ids] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.names[best], float(p[best])


def document_frequencies(docs: DataFrame, rows: int = ROWS) -> tuple[int, np.ndarray]:
    """Number of documents and, for each hashed n-gram, of those that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros(rows, np.int64), 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if has_letter(text):
                    have[gram_counts(text, rows)[0]] += 1
                    n += 1
        ids = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1)), pa.array(np.append(have[ids], n))], ["id", "n"])
    got = docs.select("text").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(rows)
    known = got[got["id"] >= 0]
    out[known["id"].to_numpy()] = known["n"].to_numpy()
    return int(got.loc[got["id"] < 0, "n"].sum()), out


def fit_ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, rows: int = ROWS,
             alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3,
             seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates; l1 keeps weights at exact zero."""
    z, n = np.zeros((rows + 1, n_classes)), np.zeros((rows + 1, n_classes))  # the last row is the bias

    def weight(ids):
        zi = z[ids]
        return -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((beta + np.sqrt(n[ids])) / alpha + l2)

    target, rng = np.eye(n_classes), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            ids, value = np.append(x[i][0], rows), np.append(x[i][1], 1.0)
            w = weight(ids)
            s = value @ w
            p = np.exp(s - s.max())
            g = np.outer(value, p / p.sum() - target[y[i]])
            grown = n[ids] + g * g
            z[ids] += g - (np.sqrt(grown) - np.sqrt(n[ids])) / alpha * w
            n[ids] = grown
    w = weight(np.arange(rows + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by a grid on its logarithm."""
    if not len(y):
        return 1.0
    def loss(t):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())
    return float(min(np.exp(np.linspace(np.log(0.05), np.log(20), 121)), key=loss))


def drawn(known: DataFrame, max_rows: int = MAX_TRAIN_ROWS, per_lang: int = MAX_LANG_ROWS) -> DataFrame:
    """At most ``max_rows`` documents (doc_id, text, lang), one row an id: the first
    of every language by the hash of the id, then the second of each and so on,
    up to ``per_lang``.  An id with several rows gives its smallest (text, lang).

    The ids are ranked by their hash, and of a language with ``n`` ids only hashes in the
    lowest ``2 * per_lang / n`` of the range enter the ranking: about twice as many as it
    can use, so a language with most of the rows is no more work than another.
    (``n`` is Spark's approximate count; fewer than ``per_lang`` hashes below that line
    are out of reach by chance.)
    """
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")) \
        .orderBy(F.desc("n"), "lang").limit(MAX_SIZES)
    share = F.col("h") / F.lit(2.0 ** 64) + 0.5
    low = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(sizes), "lang", "left") \
        .where(F.col("n").isNull() | (share * F.col("n") <= 2 * per_lang))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ranked = (low.groupBy("doc_id", "h").agg(F.min("lang").alias("lang"))
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang))
    picked = ranked.orderBy("rank", "h", "doc_id").limit(max_rows).select(F.col("doc_id").alias("picked"))
    rows = known.join(F.broadcast(picked), F.col("doc_id") == F.col("picked"), "left_semi")
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.text", "r.lang")


def train(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, out_of: int = HELD_OUT_OF,
          per_lang: int = MAX_LANG_ROWS) -> LanguageModel | None:
    """The model, learned outside the held-out fold only."""
    known = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_column(F.col("doc_id"), out_of) != 0))
    n, have = document_frequencies(known)
    sample = drawn(known, max_rows, per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(k, lang, *gram_counts(t)) for k, t, lang in zip(*(c.to_pylist() for c in batch.columns)) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(r[0]) for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                 pa.array([r[3].astype(np.float32) for r in rows], pa.list_(pa.float32()))],
                ["doc_id", "lang", "ids", "counts"])
    rows, (ids, counts) = gathered(
        sample.mapInArrow(run, "doc_id string, lang string, ids array<int>, counts array<float>"), "doc_id", "ids", "counts")
    if not rows.num_rows:
        return None
    langs = rows["lang"].to_pylist()
    names = sorted(set(langs))
    model = LanguageModel(names, np.log((1 + n) / (1 + have)) + 1, np.zeros((ROWS, len(names))), np.zeros(len(names)))
    x = [(i, model.features(i, c)) for i, c in zip(ids, counts)]
    y = np.array([names.index(v) for v in langs])
    check = np.arange(len(y)) % 7 == 3  # kept from the fit, for the temperature
    model.weights, model.bias = fit_ftrl([v for v, c in zip(x, check) if not c], y[~check], len(names))
    logits = np.array([v @ model.weights[i] + model.bias for (i, v), c in zip(x, check) if c]).reshape(-1, len(names))
    model.temperature = fit_temperature(logits, y[check])
    return model


def identify(docs: DataFrame, model: LanguageModel | None, out_of: int = HELD_OUT_OF) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [model.predict(t) if model else (UNKNOWN, 0.0) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fold(k, out_of) == 0 for k in batch.column(0).to_pylist()], pa.bool_()),
                 pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
