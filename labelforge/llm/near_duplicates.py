"""Near-duplicate documents by b-bit MinHash.

Texts with equal shingle sets form one class; the work below is on classes, so a
group of exact copies of any size costs one of them.

1. Every class gets the minima of its shingles under 128 hash functions.  Bands
   of four whole minima are the candidate keys; the low four bits of each
   minimum are packed into eight longs.
2. In each bucket of a band a pivot (pseudo-random per bucket) stands for the
   others.  The similarity of a class and a pivot is estimated from the equal
   packed groups of bits, corrected for chance collisions; pairs four standard
   errors below the threshold are let go, the others are confirmed on the full
   shingle sets: first each class with its likeliest pivot, then, across
   components only, with its other pivots.
3. Buckets that still hold several components are joined with themselves,
   across components only, on estimate and full sets inside the join, so no
   pair is emitted that isn't a link.  Thereby every two classes that share a
   bucket are linked, known to be connected, or refuted.

Shingles and classes are 64-bit hashes.  A pair at the threshold shares none of
the 32 bands with probability 5e-6.

Edge cases: null and wordless texts have an empty set, link with nothing and are
kept; a text of fewer words than a shingle is one shingle; repeated rows are
copies; a null doc_id joins a group but never names it; only doc_id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import maybe_broadcast, mix64, slices, stage
from labelforge.llm.graph import components

SHINGLE = 5
THRESHOLD = 75  # per cent of the union
HASHES, BITS, BAND = 128, 4, 4
LONGS = HASHES * BITS // 64
#: Estimates below this are let go: the threshold less four standard errors.
LEAST_ESTIMATE = 0.59
PIECE = 1 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[[32, 9, 10, 11, 12, 13]] = 0  # white space adds nothing to a word's hash
_BLANK = _BYTE == 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ORDER = _RNG.integers(1, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(1, 2 ** 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2 ** 63, HASHES, dtype=np.uint64)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of every white-space word, in pieces cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        at = end
        blank = _BLANK[raw]
        starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
        if not len(starts):
            continue
        place = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(raw))))
        power = np.cumprod(np.full(int(place.max()) + 1, _STEP))
        out.append(mix64(np.add.reduceat(_BYTE[raw] * power[place], starts)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text, A-Z lower-cased."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total += words[j:n - width + 1 + j] * _ORDER[j]
    return np.unique(mix64(total + np.uint64(width)))


def set_id(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    place = mix64(np.arange(len(shingles), dtype=np.uint64) + np.uint64(1))
    total = mix64(shingles ^ place).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (rows x LONGS) and band keys (rows x bands) of non-empty sets."""
    everything = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    minima = np.empty((len(sets), HASHES), np.uint64)
    for i in range(HASHES):
        minima[:, i] = np.minimum.reduceat(everything * _MUL[i] + _ADD[i], starts)
    low = mix64(minima) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shift = (np.arange(per) * BITS).astype(np.uint64)
    packed = np.bitwise_or.reduce(low.reshape(len(sets), LONGS, per) << shift, axis=2)
    parts = minima.reshape(len(sets), HASHES // BAND, BAND)
    keys = mix64((mix64(parts) * _ORDER[:BAND]).sum(axis=2, dtype=np.uint64) + np.arange(HASHES // BAND, dtype=np.uint64))
    return packed.view(np.int64), keys.view(np.int64)


_SIG = ", ".join(f"s{i} long" for i in range(LONGS))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, n, cls, s0.., bands): one row per document; ``cls`` is null
    and the rest zero for an empty set, ``tie`` a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            full = np.flatnonzero([len(s) > 0 for s in sets])
            packed, keys = np.zeros((len(sets), LONGS), np.int64), np.zeros((len(sets), HASHES // BAND), np.int64)
            if len(full):
                packed[full], keys[full] = signatures([sets[i] for i in full])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                 *[pa.array(packed[:, i]) for i in range(LONGS)], pa.array(list(keys), pa.list_(pa.int64()))],
                ["doc_id", "tie", "n", "cls", *[f"s{i}" for i in range(LONGS)], "bands"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(
        run, f"doc_id {kind}, tie long, n long, cls long, {_SIG}, bands array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from the packed bits, corrected for groups equal by chance."""
    ones = sum(1 << i for i in range(0, 64, BITS))
    parts = []
    for i in range(LONGS):
        x = f"({a}.s{i} ^ {b}.s{i})"
        spread = " | ".join([x] + [f"shiftrightunsigned({x}, {k})" for k in range(1, BITS)])
        parts.append(f"bit_count(({spread}) & {ones}L)")
    chance = 1.0 / (1 << BITS)
    return F.expr(f"(1 - ({' + '.join(parts)}) / {float(HASHES)}D - {chance}D) / {1 - chance}D")


def near(a: str, b: str) -> Column:
    """Sizes allow the threshold and the estimate doesn't rule it out."""
    return (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * THRESHOLD) & \
        (estimate(a, b) >= LEAST_ESTIMATE)


def confirmed(a: str, b: str) -> Column:
    """The threshold on the full sets."""
    common = F.size(F.array_intersect(f"{a}.shingles", f"{b}.shingles"))
    union = F.size(f"{a}.shingles") + F.size(f"{b}.shingles") - common
    return common * 100 >= union * THRESHOLD


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, shingles) for the classes in ``wanted``, made anew from the text of
    one document of each."""
    chosen = stage(classes.join(wanted.select("cls").distinct(), "cls").select(
        "cls", "again", F.col("doc_id").alias("rep"), F.col("tie").alias("rep_tie")), "chosen")
    texts = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")

    def texts_of(reps: DataFrame) -> DataFrame:
        return texts.join(maybe_broadcast(reps, 48), F.col("doc_id").eqNullSafe(F.col("rep"))
                          & (F.col("tie") == F.col("rep_tie"))).select("cls", "text")

    # A row that stands in the table more than once still makes one set.
    once = texts_of(chosen.where("not again"))
    if not chosen.where("again").isEmpty():
        once = once.unionByName(texts_of(chosen.where("again")).dropDuplicates(["cls"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = [shingle_set(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["cls", "shingles"])
    made = once.select("cls", "text").mapInArrow(run, "cls long, shingles array<long>")
    return stage(made, "sets")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs that are links on the full sets."""
    x, y = sets.alias("x"), sets.alias("y")
    return (pairs.join(x, F.col("a") == F.col("x.cls")).join(y, F.col("b") == F.col("y.cls"))
            .where(confirmed("x", "y")).select("a", "b"))


def class_components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, component) for the classes that link with another one."""
    keys = classes.select("cls", F.explode("bands").alias("key"))
    # The smallest cls ^ key is a class chosen by the key, alike for all members.
    pivots = keys.groupBy("key").agg(F.min(F.col("cls").bitwiseXOR(F.col("key"))).alias("x"), F.count(F.lit(1)).alias("c")) \
        .where("c > 1").select("key", F.col("x").bitwiseXOR(F.col("key")).alias("pivot"))
    members = stage(keys.join(pivots, "key"), "buckets")
    sig = classes.drop("doc_id", "tie", "bands", "again")
    star = members.where("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
    star = stage(star.join(sig.alias("p"), F.col("a") == F.col("p.cls")).join(sig.alias("q"), F.col("b") == F.col("q.cls"))
                 .where(near("p", "q")).select("a", "b", estimate("p", "q").alias("estimate")), "star")
    wanted = star.select(F.col("a").alias("cls")).unionByName(star.select(F.col("b").alias("cls")))
    sets = full_sets(docs, classes, wanted)
    first = star.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    label = components(confirm(first, sets))

    def labelled(rows: DataFrame, on: str, name: str) -> DataFrame:
        known = label.select(F.col("node").alias(on), F.col("component").alias("_c"))
        return rows.join(known, on, "left").withColumn(name, F.coalesce("_c", on)).drop("_c")

    def merged(links: DataFrame) -> DataFrame:
        return components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    label = stage(label, "labels")
    across = labelled(labelled(star.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    label = stage(merged(confirm(across, sets)), "labels")

    rows = stage(labelled(members.select("key", "cls"), "cls", "component"), "bucket-labels")
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo <> hi").select("key")
    rows = stage(rows.join(mixed, "key").join(sig, "cls"), "mixed-buckets")
    x, y = rows.alias("x"), rows.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
    # First the members with a partner that the estimate doesn't rule out; their sets join next.
    alive = stage(x.join(y, apart & near("x", "y"), "left_semi"), "alive")
    sets = full_sets(docs, classes, alive)
    rows = alive.join(sets, "cls")
    x, y = rows.alias("x"), rows.alias("y")
    links = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component"))
                   & near("x", "y") & confirmed("x", "y")).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    return merged(links.distinct()).select(F.col("node").alias("cls"), "component")


def groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable
    over links), kept (the document that names its group), cls and tie
    (hash of the text)."""
    docs = docs.select("doc_id", "text")
    rows = stage(signed(docs), "signatures")
    again = rows.where("cls is not null").groupBy("doc_id", "tie", "cls").count().where("count > 1")
    again = again.select("cls", F.lit(True).alias("again")).distinct()
    classes = (rows.where("cls is not null").dropDuplicates(["cls"]).join(again, "cls", "left")
               .withColumn("again", F.coalesce("again", F.lit(False))))
    classes = stage(classes, "classes")
    label = class_components(docs, classes)
    least = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least")) \
        .join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = stage(least, "least")
    named = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.select("cls", "component").join(named, "component").select("cls", "component_id")
    out = rows.select("doc_id", "tie", F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "cls", "tie")
