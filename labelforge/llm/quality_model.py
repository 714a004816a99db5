"""Quality classifier: supervised subword embeddings.

Words and their character n-grams are hashed to rows of a learned embedding
table; a document is the mean of its rows, a softmax layer gives the label.
Both are trained by stochastic gradient descent in numpy on a bounded sample of
labelled documents and used in every task on whole texts.  A word's summed rows
are kept in a bounded cache, so a repeated word costs one lookup.

Edge cases: null and empty texts score by the bias alone; without labels of
both kinds every score is the share of label 1 (0.5 if there are none);
repeated rows score alike; only doc_id and text are read for scoring.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import fold, fold_column, gathered, labelled_sample, slices

#: Most labelled documents that the fit reads.
MAX_TRAIN_ROWS = 4_000
HELD_OUT_OF = 5
PREDICT_AT = 0.3
ROWS = 1 << 16
DIM = 12
CACHE = 200_000
_ECHO = b"\x00again"


def subwords(words: list[bytes], rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words and of their 2- to 4-byte grams with edge marks, and
    the number of the word that each belongs to, in order of the words."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    ids, owner = [np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words))], [np.arange(len(words))]
    value = data
    for n in (2, 3, 4):
        if len(data) < n:
            break
        value = value[:-1] * np.uint32(0x01000193) + data[n - 1:]
        inside = of[:len(value)] == of[n - 1:]
        mixed = (value[inside] + np.uint32(n)) * np.uint32(0x9E3779B1)
        ids.append(mixed ^ (mixed >> np.uint32(15)))
        owner.append(of[:len(value)][inside])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(ids) % np.uint32(rows)).astype(np.int64)[order], owner[order]


def tokens(text: str | None) -> list[bytes]:
    """White-space words, with a mark added for each word equal to the one before."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return words + [_ECHO] * sum(a == b for a, b in zip(words, words[1:]))


@dataclass
class Embedding:
    table: np.ndarray  # rows x dim
    out: np.ndarray    # dim x 2
    bias: np.ndarray   # 2

    def probability(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z[:, 1] / z.sum(axis=1)


class WordSums:
    """Per word the sum of its rows and their number, kept for up to ``CACHE``
    words (then begun anew)."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.values = np.zeros((4096, self.table.shape[1] + 1), np.float32)

    def rows(self, words) -> np.ndarray:
        """Values of the words, one row each."""
        if len(self.place) > CACHE:
            self.clear()
        new = [w for w in words if w not in self.place]
        for at in range(0, len(new), 4096):
            some, first = new[at:at + 4096], len(self.place)
            ids, owner = subwords(some, len(self.table))
            starts = np.searchsorted(owner, np.arange(len(some)))
            while first + len(some) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[first:first + len(some), :-1] = np.add.reduceat(self.table[ids], starts, axis=0)
            self.values[first:first + len(some), -1] = np.diff(np.append(starts, len(ids)))
            self.place.update(zip(some, range(first, first + len(some))))
        return self.values[[self.place[w] for w in words]]


def hidden(cache: WordSums, text: str | None) -> np.ndarray:
    """Mean of the rows of a whole text."""
    count = Counter(tokens(text))
    total = np.fromiter(count.values(), float, len(count)) @ cache.rows(count) if count else np.zeros(cache.values.shape[1])
    return total[:-1] / max(total[-1], 1.0)


def bag(text: str | None, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and their weights (summing to 1) of a whole text."""
    words = Counter(tokens(text))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    count, known = np.zeros(rows), list(words)
    for at in range(0, len(known), 4096):
        ids, owner = subwords(known[at:at + 4096], rows)
        times = np.fromiter((words[w] for w in known[at:at + 4096]), float)
        count += np.bincount(ids, times[owner], rows)
    ids = np.flatnonzero(count)
    return ids, count[ids] / count.sum()


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rows: int = ROWS, dim: int = DIM, epochs: int = 8,
        rate: float = 0.6, seed: int = 11) -> Embedding | None:
    """Stochastic gradient descent, one document at a time, rate falling to 0."""
    if len(y) == 0 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (rows, dim))
    out, share = rng.normal(0, 0.1, (dim, 2)), y.mean()
    bias = np.log([1 - share, share])
    target = np.eye(2)[y.astype(int)]
    total, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids, weight = bags[i]
            now = rate * (1 - step / total)
            step += 1
            mean = weight @ table[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            delta = p / p.sum() - target[i]
            back = out @ delta
            out -= now * np.outer(mean, delta)
            bias -= 0.05 * now * delta
            # The mean divides a row's gradient by the text's length; undone up to a bound.
            table[ids] -= now * np.outer(np.minimum(weight * 50, 1.0), back)
    return Embedding(table, out, bias)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS,
          out_of: int = HELD_OUT_OF) -> tuple[Embedding | None, float]:
    """The model and the share of label 1, from at most ``max_rows`` labelled
    documents outside the held-out fold; their bags are made in Spark."""
    sample = labelled_sample(docs, labels, "quality", fold_column(F.col("doc_id"), out_of) != 0, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bags = [bag(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1),
                 pa.array([b[0].astype(np.int32) for b in bags], pa.list_(pa.int32())),
                 pa.array([b[1].astype(np.float32) for b in bags], pa.list_(pa.float32()))],
                ["doc_id", "label", "ids", "weights"])
    rows, (ids, weights) = gathered(
        sample.select("doc_id", "label", "text").mapInArrow(
            run, "doc_id string, label int, ids array<int>, weights array<float>"), "doc_id", "ids", "weights")
    y = rows["label"].to_numpy().astype(float)
    return fit(list(zip(ids, weights)), y), float(y.mean()) if len(y) else 0.5


def score(docs: DataFrame, model: Embedding | None, share: float = 0.5, at: float = PREDICT_AT,
          out_of: int = HELD_OUT_OF) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    # Single precision halves what every task loads.
    table = None if model is None else model.table.astype(np.float32)
    head = None if model is None else Embedding(np.zeros((0, 0)), model.out, model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = None if table is None else WordSums(table)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            if cache is None:
                p = np.full(len(texts), share)
            else:
                p = head.probability(np.stack([hidden(cache, t) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fold(k, out_of) == 0 for k in batch.column(0).to_pylist()], pa.bool_()),
                 pa.array(p, pa.float64()), pa.array((p >= at).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")
