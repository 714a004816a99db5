"""Quality rules: gradient-boosted trees over document statistics.

Fixed base rules come first (too short, too repetitive); on the rest a boosted
ensemble decides.  Trees are fitted with numpy on histograms of the statistics
of a bounded sample of labelled documents, with monotonic constraints (more
symbols or more repetition never raises the score), and flattened into node
arrays that score a batch of documents at once, inside Arrow batches.

Edge cases: a null or empty text has zero statistics and fails the base rules;
repeated rows are judged alike; without labels of both kinds there is no
ensemble and the base rules decide alone; only doc_id and text are read, other
columns pass through the filter untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import labelled_sample, logistic, slices

#: Most labelled documents that the fit reads.
MAX_TRAIN_ROWS = 20_000
KEEP_AT = 0.3
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: (statistic, direction in which quality may move as it grows; 0: any)
FEATURES = (("log_words", 0), ("word_length", 0), ("symbol_share", -1), ("dup_line_share", -1),
            ("repeat_share", -1), ("upper_share", -1), ("digit_share", 0), ("distinct_share", 0),
            ("bar_share", -1), ("lines_per_word", 0), ("closed_line_share", 0), ("echo_share", -1))
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def repeated_words(ids: np.ndarray, n_ids: int) -> int:
    """Words within 3-word windows that occur twice or more (the first included)."""
    n = len(ids)
    if n < 4 or n_ids == n:
        return 0
    key = (ids[:-2] * n_ids + ids[1:-1]) * n_ids + ids[2:] if n_ids < 2_000_000 else None
    if key is None:
        pairs = np.unique(ids[:-1] * n_ids + ids[1:], return_inverse=True)[1]
        key = pairs[:-1] * n_ids + ids[2:]
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the ensemble's features of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at \x20 and \x09-\x0D only
    n = len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(text) - int(counts[32] + counts[9:14].sum())
    symbols = int(counts[_SYMBOLS].sum())
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(place.__getitem__, words), np.int64, n)
    repeat = repeated_words(ids, len(place))
    letters = max(int(counts[65:91].sum() + counts[97:123].sum()), 1)
    some, some_lines = max(n, 1), max(len(lines), 1)
    closed = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    return [n, chars, symbols, dup, repeat], [
        float(np.log1p(n)), chars / some, symbols / some, dup / some_lines, repeat / some,
        int(counts[65:91].sum()) / letters, int(counts[48:58].sum()) / max(chars, 1), len(place) / some,
        int(counts[124]) / some, len(lines) / some, closed / some_lines,
        int((ids[1:] == ids[:-1]).sum()) / some]


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


@dataclass
class Trees:
    """Flattened ensemble: node arrays of all trees, one root per tree."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return logistic(self.start + self.value[node].sum(axis=1))


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int], rounds: int = 60, depth: int = 3,
              rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Trees | None:
    """Newton boosting of the logistic loss on binned features.

    A split on a constrained feature is made only if the two leaf weights are in
    the allowed order; both sides then stay on their side of the midpoint."""
    if len(y) == 0 or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), start)
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots = []
    for _ in range(rounds):
        p = logistic(raw)
        g, h = y - p, p * (1 - p)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            at = len(nodes)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            weight = float(np.clip(total_g / (total_h + ridge), low, high))
            nodes.append([0, np.inf, at, at, rate * weight])
            best = (1e-6, None)
            if level < depth:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gs = np.bincount(code[rows, j], g[rows], len(e) + 1).cumsum()[:-1]
                    hs = np.bincount(code[rows, j], h[rows], len(e) + 1).cumsum()[:-1]
                    wl = np.clip(gs / (hs + ridge), low, high)
                    wr = np.clip((total_g - gs) / (total_h - hs + ridge), low, high)
                    gain = (gs * wl - 0.5 * (hs + ridge) * wl ** 2 + (total_g - gs) * wr
                            - 0.5 * (total_h - hs + ridge) * wr ** 2
                            - (total_g * weight - 0.5 * (total_h + ridge) * weight ** 2))
                    ok = (hs >= least) & (total_h - hs >= least) & (directions[j] * (wr - wl) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, wl[k], wr[k]))
            if best[1] is not None:
                j, k, wl, wr = best[1]
                middle = 0.5 * (wl + wr)
                lows, highs = (low, middle), (middle, high)
                bounds = {0: ((low, high), (low, high)), 1: (lows, highs), -1: (highs, lows)}[directions[j]]
                goes_left = code[rows, j] <= k
                nodes[at][0], nodes[at][1] = j, float(edges[j][k])
                nodes[at][2] = grow(rows[goes_left], level + 1, *bounds[0])
                nodes[at][3] = grow(rows[~goes_left], level + 1, *bounds[1])
            return at

        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        a = np.array(nodes[roots[-1]:])
        tree = Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int) - roots[-1], a[:, 3].astype(int) - roots[-1],
                     a[:, 4], np.array([0]), depth, 0.0)
        node = np.zeros(len(y), int)
        for _ in range(depth):
            node = np.where(x[np.arange(len(y)), tree.feature[node]] <= tree.cut[node], tree.left[node], tree.right[node])
        raw = raw + tree.value[node]
    a = np.array(nodes)
    return Trees(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4],
                 np.array(roots, np.int32), depth, start)


_STAT_SCHEMA = ", ".join(f"{n} long" for n in BASE) + ", features array<double>"


def with_statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, base counts, features) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [statistics(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([g[0][i] for g in got], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array([g[1] for g in got], pa.list_(pa.float64()))],
                [key, *BASE, "features"])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, {_STAT_SCHEMA}")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Trees | None:
    """The ensemble, from at most ``max_rows`` labelled documents (their
    statistics, a dozen numbers each, are gathered on the driver)."""
    sample = labelled_sample(docs, labels, "quality", F.lit(True), max_rows)
    rows = (with_statistics(sample.select(F.struct("doc_id", "label").alias("k"), "text"), "k")
            .select("k.doc_id", "k.label", "features").toPandas().sort_values("doc_id", kind="stable"))
    if not len(rows):
        return None
    return fit_trees(np.array(rows["features"].tolist()), rows["label"].to_numpy(float), [d for _, d in FEATURES])


def _verdicts(texts: list[str | None], trees: Trees | None, keep_at: float):
    got = [statistics(t) for t in texts]
    failed = np.array([base_failed(b[0], b[4]) for b, _ in got], bool)
    score = trees.score(np.array([f for _, f in got])) if trees is not None and got else 1.0 - failed
    return [b for b, _ in got], failed, score, ~failed & (score >= keep_at)


def judge(docs: DataFrame, trees: Trees | None, keep_at: float = KEEP_AT) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, failed, score, kept = _verdicts(batch.column(1).to_pylist(), trees, keep_at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([b[i] for b in base], pa.int64()) for i in range(len(BASE))],
                 pa.array(failed), pa.array(kept), pa.array(score.astype(float))],
                ["doc_id", *BASE, "base_failed", "kept", "score"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, {', '.join(f'{n} long' for n in BASE)}, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, trees: Trees | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were, no shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(_verdicts(batch.column(at).to_pylist(), trees, keep_at)[3]))
    return docs.mapInArrow(run, docs.schema)
