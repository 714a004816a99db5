"""Toxicity: a support vector machine with a gap-weighted subsequence string
kernel over the words of a text, approximated with Nystroem landmarks.

The kernel sums, over all 3-character subsequences that two words share,
``decay ** (span in one + span in the other)``, so an insult with a character
put between its letters keeps most of its similarity.  Words are taken without
the signs inside them, and runs of single letters are joined, which covers
spelled-out insults.  The explicit map of the kernel is small (subsequences
within one word), so ``landmarks -> kernel -> decision`` folds into one weight
per subsequence: the decision for a word is a sparse sum.

Texts are labelled, words are not.  Words that stand in toxic texts far more often
than in others, counted over all labelled texts outside the held-out fold, are
candidates; the positive examples are those that
explain the toxic texts, chosen one after the other by the texts not explained
yet, so words that merely share a text with an insult (or copies of it) drop
out.  Negative examples are other words, and in a few rounds those of them that
the machine rates highest.  Landmarks are drawn from both sides.  A text's score
is a logistic of its highest word decision, its number of positive words and
their share, fitted on the training texts.

Edge cases: null, empty and wordless texts score by the logistic's constant;
without labels of both kinds every score is the share of toxic labels (0 if
there are none); repeated rows score alike; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import fold, fold_column, in_filter, logistic, one_per_id, slices, stage

#: Most labelled documents, candidate words and other words that the fit reads, and toxic texts
#: that speak for a word besides the first ``MAX_TRAIN_ROWS`` of all.
MAX_TRAIN_ROWS = 8_000
MAX_CANDIDATES = 2_000
MAX_HOLDERS = 8
MAX_NEGATIVE = 1_600
MINING_ROUNDS = 2
LANDMARKS = 240
HELD_OUT_OF, HELD_OUT = 3, 1
PREDICT_AT = 0.7
DECAY = 0.5
#: Furthest distance between the first and the last character of a subsequence.
REACH = 7
PIECE = 24
CACHE = 300_000
GROUP = 1 << 20
_CODES = 64
_SPELLED = re.compile(r"(?<!\w)\w(?:[\s._*-]\w){2,}(?!\w)")
_SIGNS = re.compile(r"[\W_]+")


def plain_words(text: str | None) -> Counter:
    """Words of the lower-cased text, signs taken out, with their counts; runs
    of single characters (``i d i o t``) also count as one word."""
    text = (text or "").lower()
    count = Counter(text.split())
    for raw in [w for w in count if not w.isalnum()]:
        n, word = count.pop(raw), _SIGNS.sub("", raw)
        if word:
            count[word] += n
    for run in _SPELLED.findall(text):
        count[_SIGNS.sub("", run)] += 1
    return count


@cache
def _subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the 3-character subsequences of n characters."""
    places = [(i, j, k) for i in range(n) for j in range(i + 1, min(i + REACH, n)) for k in range(j + 1, min(i + REACH + 1, n))]
    places = np.array(places or np.zeros((0, 3)), int)
    return places, DECAY ** (places[:, 2] - places[:, 0] + 1.0)


@cache
def _code(c: str) -> int:
    o = ord(c)
    return o - 97 if 97 <= o <= 122 else 28 + o * 40503 % 36


def _codes(word: str) -> list[int]:
    """Marked characters as numbers below 64: a-z, then edges, then the others."""
    return [26, *map(_code, word), 27]


def word_map(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For words of equal length at a time: (their places in the list, subsequence
    keys, weights, norms), one row per word.  Words are at most ``PIECE`` characters.
    Where no character of a word repeats, no key does, and all norms are one value."""
    alike: dict[tuple[int, bool], list[int]] = {}
    codes = [_codes(w) for w in words]
    for i, c in enumerate(codes):
        alike.setdefault((len(c), len(set(c)) < len(c)), []).append(i)
    for (n, repeats), members in alike.items():
        places, weight = _subsequences(n)
        for at in range(0, len(members), 1024):
            some = members[at:at + 1024]
            code = np.array([codes[i] for i in some], np.int64)
            keys = (code[:, places[:, 0]] * _CODES + code[:, places[:, 1]]) * _CODES + code[:, places[:, 2]]
            norm = norms(keys, weight) if repeats else np.full(len(some), np.sqrt(max((weight * weight).sum(), 1e-12)))
            yield np.array(some), keys, weight, norm


def norms(keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square root of each word's kernel with itself (equal keys add up first)."""
    order = np.argsort(keys, axis=1, kind="stable")
    sorted_keys, w = np.take_along_axis(keys, order, axis=1), weight[order]
    new = np.ones(keys.shape, bool)
    new[:, 1:] = sorted_keys[:, 1:] != sorted_keys[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    row = np.repeat(np.arange(len(keys)), new.sum(axis=1))
    return np.sqrt(np.maximum(np.bincount(row, sums * sums, len(keys)), 1e-12))


def subsequence_keys(words: list[str]) -> np.ndarray:
    """Distinct subsequence keys of the words, sorted."""
    return np.unique(np.concatenate([np.unique(keys) for _, keys, _, _ in word_map(words)]))


def explicit(words: list[str], known: np.ndarray) -> np.ndarray:
    """Normalised kernel map of each word on the ``known`` subsequences."""
    out = np.zeros((len(words), len(known)), np.float32)
    for at, keys, weight, norm in word_map(words):
        share = weight[None, :] / norm[:, None]
        column = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[column] == keys
        np.add.at(out, (np.broadcast_to(at[:, None], keys.shape)[hit], column[hit]), share[hit])
    return out


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel of every word of ``a`` with every word of ``b`` (only
    subsequences of ``b`` count)."""
    known = subsequence_keys(b)
    right = explicit(b, known).T
    return np.concatenate([explicit(a[i:i + 256], known) @ right for i in range(0, len(a), 256)])


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Linear machine with squared hinge loss (last column of the result: bias), by
    Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, total = np.zeros(x.shape[1]), weight.sum()
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(rounds):
        inside = (y * (x @ w)) < 1
        a = x[inside] * weight[inside, None] / total
        new = np.linalg.solve(penalty + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * (w + new)
    return w


def link_inputs(features: np.ndarray) -> np.ndarray:
    """Inputs of the logistic from (highest decision, positive words, words)."""
    highest, positive, n = features.reshape(-1, 3).T
    return np.column_stack([np.clip(highest, -3, 3), np.log1p(positive), np.log1p(100 * positive / np.maximum(n, 1)),
                            np.ones(len(highest))])


@dataclass
class ToxicModel:
    weight: np.ndarray  # one per subsequence: landmarks, kernel and machine folded
    bias: float
    link: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0)

    def decisions(self, words: list[str]) -> np.ndarray:
        """Decision per word; a word above ``PIECE`` characters has the highest
        decision of its overlapping pieces."""
        pieces, owner = [], []
        for i, w in enumerate(words):
            for at in range(0, max(len(w) - PIECE, 0) + 1, PIECE // 2):
                pieces.append(w[at:at + PIECE])
                owner.append(i)
            if len(w) > PIECE:
                pieces.append(w[-PIECE:])
                owner.append(i)
        value = np.zeros(len(pieces))
        for at, keys, weight, norm in word_map(pieces):
            value[at] = self.weight[keys] @ weight / norm
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, np.array(owner, int), value + self.bias)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return logistic(link_inputs(features) @ np.array(self.link))


class Decider:
    """Text features under a model: highest word decision, number of positive
    words and of words, with a bounded cache of word decisions."""

    def __init__(self, model: ToxicModel):
        self.model, self.known = model, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row per text.  Words are decided for ``GROUP`` characters of texts at a
        time: few words of each length make slow arrays."""
        out, at = [], 0
        while at < len(texts):
            counts, held = [], 0
            while at < len(texts) and (not counts or held + len(texts[at] or "") <= GROUP):
                counts.append(plain_words(texts[at]))
                held += len(texts[at] or "")
                at += 1
            self.decide(set().union(*counts))
            out.extend(self.of(count) for count in counts)
        return np.array(out, float).reshape(-1, 3)

    def decide(self, words: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known = {}
        new = sorted(words - self.known.keys())
        for i in range(0, len(new), 4096):
            some = new[i:i + 4096]
            self.known.update(zip(some, self.model.decisions(some).tolist()))

    def of(self, count: Counter) -> tuple[float, int, int]:
        known = self.known
        highest = max(-3.0, max(map(known.__getitem__, count), default=-3.0))
        positive = sum(n for w, n in count.items() if known[w] > 0) if highest > 0 else 0
        return highest, positive, count.total()


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, toxic, other): training texts of each label that have the word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            toxic, other = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else other).update(plain_words(text).keys())
            words = list(toxic | other)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()),
                                              pa.array([other[w] for w in words], pa.int64())], ["word", "toxic", "other"])
    got = sample.select("label", "text").mapInArrow(run, "word string, toxic long, other long")
    return got.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def text_features(texts: DataFrame, model: ToxicModel, key: str) -> DataFrame:
    """(key, features) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decider = Decider(model)
        for batch in slices(batches):
            got = decider.features(batch.column(1).to_pylist()).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], [key, "features"])
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, features array<double>")


def fit_link(features: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic of the weighted text features by Newton's method."""
    x = link_inputs(features)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)),
                               x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def holders(sample: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, word) for the given words in the toxic training texts."""
    wanted = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(k, w) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for w in plain_words(t).keys() & wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type),
                                              pa.array([r[1] for r in rows], pa.string())], ["doc_id", "word"])
    kind = sample.schema["doc_id"].dataType.simpleString()
    return sample.where("label = 1").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, word string")


def speaking(held: DataFrame, max_docs: int, most: int = MAX_HOLDERS) -> DataFrame:
    """``held`` for the first ``max_docs`` texts by hash, and for the first ``most`` texts of
    every word, so rare words keep theirs: one rule whatever the number of texts."""
    order = Window.partitionBy("word").orderBy(F.xxhash64("doc_id"), "doc_id")
    of_word = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("doc_id")
    of_all = held.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    return held.join(of_all.union(of_word).distinct(), "doc_id", "left_semi")


def explain(words: list[str], odds: np.ndarray, doc: np.ndarray, word: np.ndarray) -> dict[str, float]:
    """Words that explain the texts, with the texts' weight that each took.  The
    next word is the one with the largest weight of its texts times its odds; the
    weight of those texts then falls to a quarter."""
    texts = [doc[word == j] for j in range(len(words))]
    left = np.ones(doc.max() + 1 if len(doc) else 0)
    taken: dict[str, float] = {}
    for _ in words:
        gain = np.bincount(word, left[doc], len(words)) if len(doc) else np.zeros(len(words))
        value = np.where([w in taken for w in words], 0, gain * odds)
        j = int(value.argmax())
        if gain[j] < 1.5 or value[j] <= 0:
            break
        taken[words[j]] = float(gain[j])
        left[texts[j]] *= 0.25
    return taken


def rated(words: DataFrame, model: ToxicModel, most: int) -> list[str]:
    """The ``most`` words with the highest decisions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            got = model.decisions(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["word", "decision"])
    best = words.select("word").mapInArrow(run, "word string, decision double")
    return [r["word"] for r in best.orderBy(F.col("decision").desc(), "word").limit(most).collect()]


def fit_words(positive: dict[str, float], negative: list[str], landmarks: int = LANDMARKS) -> ToxicModel:
    """The machine on word examples; both sides weigh alike, a positive word by
    the texts that it explains."""
    pos = list(positive)
    n_pos = min(len(pos), landmarks // 2)
    step = max(len(negative) // max(landmarks - n_pos, 1), 1)
    marks = pos[:n_pos] + negative[::step][:landmarks - n_pos]
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(float))
    kept = value > 1e-4 * value.max()
    half = vector[:, kept] / np.sqrt(value[kept])
    x = kernel(pos + negative, marks).astype(float) @ half
    y = np.append(np.ones(len(pos)), -np.ones(len(negative)))
    evidence = np.sqrt(np.array(list(positive.values())))
    machine = fit_svm(x, y, np.append(evidence / evidence.sum(), np.full(len(negative), 1 / len(negative))))
    known, weight = subsequence_keys(marks), np.zeros(_CODES ** 3)
    weight[known] = (half @ machine[:-1]) @ explicit(marks, known)
    return ToxicModel(weight, float(machine[-1]))


def stratified(marked: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled ids by the smallest hash; toxic ones are up to half."""
    def first(label: int, most: int) -> DataFrame:
        return marked.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    n0 = marked.where("label = 0").count()
    n1 = min(marked.where("label = 1").count(), max(max_rows // 2, max_rows - n0))
    return first(1, n1).union(first(0, max_rows - n1))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, out_of: int = HELD_OUT_OF,
          held_out: int = HELD_OUT) -> tuple[ToxicModel | None, float]:
    """The model and the share of toxic labels outside the held-out fold.  Words are
    counted over all labelled documents there; the machine and the logistic are
    fitted on at most ``max_rows`` of them, stratified by label and weighted back."""
    keep = fold_column(F.col("doc_id"), out_of) != held_out
    marked = stage(labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
                   .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & keep)
                   .groupBy("doc_id").agg(F.max("label").alias("label")), "toxic-labels")
    # The join is a shuffle at every size, of the labelled texts alone.
    texts = in_filter(docs.select("doc_id", "text").where(keep), marked, "doc_id")
    labelled = stage(texts.join(marked.hint("merge"), "doc_id").select("doc_id", "label", "text"), "toxic-labelled")
    drawn = F.broadcast(stratified(marked, max_rows).select("doc_id"))   # ``max_rows`` ids at most
    sample = stage(one_per_id(labelled.join(drawn, "doc_id", "left_semi")).select("doc_id", "label", "text"), "toxic-sample")

    def by_label(rows: DataFrame) -> dict:
        return {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = by_label(labelled)
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    share = n1 / max(n1 + n0, 1)
    if not n1 or not n0:
        return None, share
    words = stage(word_counts(labelled), "toxic-words")
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("other") + 0.5) / (n0 + 1.0))
    words = words.where(F.length("word") <= PIECE).withColumn("odds", odds)
    # How sure the odds are grows with the count.
    surely = F.col("odds") * F.sqrt(F.col("toxic").cast("double"))
    seeds = (words.where((F.col("toxic") >= 2) & (F.col("odds") > 2)).orderBy(surely.desc(), "word")
             .limit(MAX_CANDIDATES).toPandas())
    fitted = word_counts(sample).where("other > 0").select("word")
    common = stage(words.where(F.col("odds") < 1).join(fitted, "word", "left_semi"), "toxic-common")
    negative = common.orderBy(F.col("other").desc(), "word").limit(MAX_NEGATIVE // 2).select("word") \
        .union(common.orderBy(F.xxhash64("word"), "word").limit(MAX_NEGATIVE // 2).select("word")).distinct().toPandas()
    negative = sorted(negative["word"])
    if not len(seeds) or not negative:
        return None, share
    names = list(seeds["word"])
    held = speaking(stage(holders(labelled, names).distinct(), "toxic-holders"), max_rows).toPandas()
    doc = np.unique(held["doc_id"].astype(str), return_inverse=True)[1]
    place = {w: i for i, w in enumerate(names)}
    positive = explain(names, seeds["odds"].to_numpy(), doc, held["word"].map(place).to_numpy(int))
    if not positive:
        return None, share
    model = fit_words(positive, negative)
    for _ in range(MINING_ROUNDS):
        hard = rated(common, model, MAX_NEGATIVE // 4)
        negative = sorted(set(negative) | set(hard))
        model = fit_words(positive, negative)
    got = text_features(sample.select(F.struct("doc_id", "label").alias("k"), "text"), model, "k") \
        .select("k.doc_id", "k.label", "features").toPandas().sort_values("doc_id", kind="stable")
    label = got["label"].to_numpy(int)
    drawn = np.bincount(label, minlength=2)
    # Back to the share of all labels, then tempered: the rare side weighs by the root of the ratio.
    weight = np.array([n0, n1]) / np.maximum(drawn, 1) * np.array([1.0, max(1.0, np.sqrt(n0 / n1))])
    model.link = fit_link(np.array(got["features"].tolist()), label.astype(float), (weight * len(label) / (n0 + n1))[label])
    return model, share


def score(docs: DataFrame, model: ToxicModel | None, share: float = 0.0, at: float = PREDICT_AT,
          out_of: int = HELD_OUT_OF, held_out: int = HELD_OUT) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decider = Decider(model) if model else None
        for batch in slices(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if decider:
                p = model.score(decider.features(texts))
            else:
                p = np.full(len(texts), share)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fold(k, out_of) == held_out for k in keys], pa.bool_()),
                 pa.array(p, pa.float64()), pa.array((p >= at).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")
