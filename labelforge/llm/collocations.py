"""Phrase collocations by the stripes pattern.

A stripe is a prefix with an associative counter of the words that follow it.
Tasks count stripes over chunks of text, Spark merges them elementwise, and the
merged stripe gives three things at once: the prefix's extensions (entries), its
total (the sum of all entries, the end of a piece being one) and the largest
extension, which decides subsumption.

Stripes are counted in four scans: the empty prefix (words), then prefixes of one,
two and three words.  A phrase can only be frequent if all its parts are, so a scan
skips what a bitmap of the frequent phrases of the scan before rules out.  The
bitmap's size is bounded by ``MAX_BITS``; false hits cost work, never a row: all
decisions are taken on merged exact counts.

A frequent prefix is dealt in several shards by a hash of the next word, as many
as its own count asks for, so that no merge holds more than about 1/4096 of the
corpus or 65,536 occurrences.

Edge cases: null text is empty; null lang is ``und``; repeated rows count as often
as they stand there; a text of any length is one stretch of words; an empty table
gives no rows; columns other than text and lang are not read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import mix64, stage, word_runs

CHUNK_BYTES = 8 << 20   # text of one lang counted at once
HELD_BYTES = 24 << 20   # text a task holds before it counts the largest lang
MAX_BITS = 1 << 28      # of a bitmap: 32 MB
SHARD_LEAST = 1 << 16   # occurrences of a prefix before it is cut into shards
SHARD_SHARE = 4096      # ... or this part of all words, at most so many hot prefixes
SALTS = 64

#: A-Z lower-cased, the ends of a piece as \n, the spaces between words as \x20.
_TEXT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09",
                        b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_STRIPES = "lang string, prefix string, shard int, next array<string>, n array<bigint>"


class Chunk:
    """The words of some texts of one lang as codes, with the piece each is in."""

    def __init__(self, lang: str, texts: list[str]):
        blob = "\n".join(texts).encode().translate(_TEXT)
        words, starts, _ = word_runs(blob, b" \n")
        ends = np.flatnonzero(np.frombuffer(blob, np.uint8) == 10)
        self.lang, self.piece = lang, np.searchsorted(ends, starts)
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.size = len(coded.dictionary)
        self.words = pa.concat_arrays([coded.dictionary, pa.array([""], pa.string())])  # "" ends a piece
        self.hashes = np.array([phrase_hash(lang, [w]) for w in self.words.to_pylist()], np.uint64)

    def follows(self) -> np.ndarray:
        """Whether the next word lies in the same piece."""
        out = np.zeros(len(self.codes), bool)
        out[:-1] = self.piece[1:] == self.piece[:-1]
        return out


def phrase_hash(lang: str, words: list[str]) -> int:
    """Hash of a phrase, the same in every task."""
    each = [np.array([zlib.crc32(f"{lang} {w}".encode())], np.uint64) for w in words]
    return int(functools.reduce(pair_hash, each)[0])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and the last word's."""
    return mix64((a << np.uint64(32)) ^ mix64(a) ^ b)


class Bitmap:
    """Which phrase hashes may be frequent."""

    def __init__(self, bits: int, slots: np.ndarray, values: np.ndarray):
        self.mask = np.uint64(bits - 1)
        self.cells = np.zeros(bits >> 6, np.uint64)
        self.cells[slots] = values

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def bitmap(frequent: DataFrame, rows: int) -> Bitmap:
    """The bitmap of (lang, phrase) rows: 32 bits a phrase, ``MAX_BITS`` at most."""
    bits = min(MAX_BITS, 1 << max(16, math.ceil(math.log2(32 * max(rows, 1)))))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist())
            at = np.array([phrase_hash(a, p.split(" ")) for a, p in pairs], np.uint64) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)),
                 pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["slot", "bits"])

    cells = (frequent.select("lang", "phrase").mapInArrow(positions, "slot bigint, bits bigint")
             .groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow())
    return Bitmap(bits, cells["slot"].to_numpy(), cells["bits"].to_numpy().view(np.uint64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    held: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            lang, text = lang.as_py(), text.as_py()
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] < CHUNK_BYTES and sum(sizes.values()) < HELD_BYTES:
                continue
            most = max(sizes, key=sizes.get)
            sizes.pop(most)
            yield Chunk(most, held.pop(most))
    for lang, texts in held.items():
        yield Chunk(lang, texts)


def _stripes(chunk: Chunk, prefixes: pa.Array, run: np.ndarray, after: np.ndarray, hot: dict) -> pa.RecordBatch:
    """Rows of stripes: occurrence i of prefix ``run[i]`` is followed by word
    ``after[i]`` (``chunk.size``: by none that counts)."""
    width = chunk.size + 1
    pairs, counts = np.unique(run * width + after, return_counts=True)
    prefix, follow = pairs // width, pairs % width
    shards = np.ones(len(prefixes), np.int64)
    if hot:
        names = prefixes.to_pylist()
        shards[:] = [hot.get((chunk.lang, name), 1) for name in names]
    shard = (chunk.hashes[follow] % shards[prefix].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((shard, prefix))
    prefix, shard, follow, counts = prefix[order], shard[order], follow[order], counts[order]
    new = np.flatnonzero(np.diff(prefix, prepend=-1) | np.diff(shard, prepend=-1))
    offsets = pa.array(np.append(new, len(prefix)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk.lang] * len(new), pa.string()), prefixes.take(pa.array(prefix[new])),
         pa.array(shard[new].astype(np.int32)),
         pa.ListArray.from_arrays(offsets, chunk.words.take(pa.array(follow))),
         pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))],
        ["lang", "prefix", "shard", "next", "n"])


def _words(chunk: Chunk) -> Iterator[pa.RecordBatch]:
    """The stripe of the empty prefix."""
    none = pa.array([""], pa.string())
    yield _stripes(chunk, none, np.zeros(len(chunk.codes), np.int64), chunk.codes, {})


def _after_one(chunk: Chunk, words: Bitmap, hot: dict) -> Iterator[pa.RecordBatch]:
    """Stripes of prefixes of one word."""
    ok = words.holds(chunk.hashes)[chunk.codes]
    both = chunk.follows()
    both[:-1] &= ok[1:]
    after = np.where(both, np.roll(chunk.codes, -1), chunk.size)
    yield _stripes(chunk, chunk.words, chunk.codes[ok], after[ok], hot)


def _joined(chunk: Chunk, at: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
    """The phrases of ``size`` words that start at ``at``: (distinct, which of them)."""
    names, run = chunk.words, chunk.codes[at]
    for k in range(1, size):
        keys, run = np.unique(run * chunk.size + chunk.codes[at + k], return_inverse=True)
        names = pc.binary_join_element_wise(names.take(pa.array(keys // chunk.size)),
                                            chunk.words.take(pa.array(keys % chunk.size)), " ")
    return names, run


def _known(chunk: Chunk, known: Bitmap, size: int) -> np.ndarray:
    """Whether ``known`` holds the phrase of ``size`` words that starts at a word;
    two places are appended that never do."""
    follows, out = chunk.follows(), np.zeros(len(chunk.codes) + 2, bool)
    inside = np.ones(len(chunk.codes), bool)
    for k in range(size - 1):
        inside[:len(inside) - k] &= follows[k:]
        inside[len(inside) - k:] = False
    at = np.flatnonzero(inside)
    hashes = chunk.hashes[chunk.codes]
    key = hashes[at]
    for k in range(1, size):
        key = pair_hash(key, hashes[at + k])
    out[at] = known.holds(key)
    return out


def _after_phrase(chunk: Chunk, known: Bitmap, size: int, hot: dict) -> Iterator[pa.RecordBatch]:
    """Stripes of prefixes of ``size`` words."""
    known = _known(chunk, known, size)
    at = np.flatnonzero(known)
    if len(at):
        names, run = _joined(chunk, at, size)
        codes = np.append(chunk.codes, np.full(size + 1, chunk.size))
        yield _stripes(chunk, names, run, np.where(known[at + 1], codes[at + size], chunk.size), hot)


def count_stripes(docs: DataFrame, count: Callable[[Chunk], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The stripes of every chunk of every task, unmerged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            if len(chunk.codes):
                yield from count(chunk)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())
    return texts.mapInArrow(run, _STRIPES)


def merge_stripes(stripes: DataFrame, least: int) -> DataFrame:
    """Merged stripes in long form: (lang, prefix, shard, next, n) for extensions
    with ``least`` or more occurrences, and one row with a null ``next`` for the
    rest of the stripe.

    Stripes are dealt by (lang, prefix, shard); both aggregates run where they
    then lie.
    """
    keys = ["lang", "prefix", "shard"]
    dealt = stripes.repartition(*keys)
    entries = dealt.select(*keys, F.explode(F.arrays_zip("next", "n")).alias("e")).select(*keys, "e.next", "e.n")
    merged = entries.groupBy(*keys, "next").agg(F.sum("n").alias("n"))
    known = F.when((F.col("n") >= least) & (F.col("next") != ""), F.col("next"))
    return merged.groupBy(*keys, known.alias("next")).agg(F.sum("n").alias("n"))


def _share(everything: int) -> int:
    return max(SHARD_LEAST, everything // SHARD_SHARE)


def _hot(frequent: DataFrame, everything: int) -> dict[tuple[str, str], int]:
    """Shards of the prefixes that need more than one: at most ``SHARD_SHARE`` of
    them a prefix length, as each has more than that part of all words."""
    share = _share(everything)
    rows = frequent.where(F.col("n") > share).select("lang", "phrase", "n").collect()
    return {(r.lang, r.phrase): -(-r.n // share) for r in rows}


def phrases(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Exact counts of what occurs ``least`` times or more: (totals of the prefixes
    of one to three words, extended phrases of two to four words with their prefix
    and last word, words per lang, occurrences that make a phrase hot)."""
    spark = docs.sparkSession
    level = count_stripes(docs, _words)
    level = level.select("lang", F.explode(F.arrays_zip("next", "n")).alias("e")).select("lang", "e.next", "e.n")
    level = level.groupBy("lang", "next").agg(F.sum("n").alias("n"))
    level = level.groupBy("lang", F.when(F.col("n") >= least, F.col("next")).alias("phrase")).agg(F.sum("n").alias("n"))
    words = stage(level, "words")
    per_lang = words.groupBy("lang").agg(F.sum("n").alias("n"))
    sums = words.agg(F.sum("n"), F.count("phrase")).first()
    everything = sums[0] or 0
    frequent = words.where("phrase is not null")
    known = spark.sparkContext.broadcast((bitmap(frequent, sums[1]), _hot(frequent, everything)))
    pairs = stage(merge_stripes(count_stripes(docs, lambda c: _after_one(c, *known.value)), least), "stripes")
    longer, stripes = pairs, pairs
    for size in (2, 3):
        frequent = (longer.where("next is not null")
                    .select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), "n"))
        more = spark.sparkContext.broadcast((bitmap(frequent, frequent.count()), size, _hot(frequent, everything)))
        longer = stage(merge_stripes(count_stripes(docs, lambda c, more=more: _after_phrase(c, *more.value)), least), "stripes")
        stripes = stripes.unionByName(longer)
    totals = (stripes.groupBy("lang", "prefix").agg(F.sum("n").alias("f"), F.max(F.when(F.col("next").isNotNull(), F.col("n")))
                                                   .alias("most"))
              .where(F.col("f") >= least))
    extended = (stripes.where("next is not null")
                .select("lang", "prefix", "next", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("n").alias("a")))
    return totals, extended, per_lang, _share(everything)


def _words_of(phrase: str, first, size) -> F.Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def _look_up(cuts: DataFrame, totals: DataFrame, hot: DataFrame, part: str, out: str) -> DataFrame:
    """Add the count of ``part``.

    The few parts in ``hot`` stand in very many phrases: their counts are broadcast,
    and their rows are dealt by a salt in the join that finds the other counts."""
    hot = F.broadcast(hot.select("lang", F.col("prefix").alias(part), F.col("f").alias("hot_f")))
    cold = totals.select("lang", F.col("prefix").alias(part), F.lit(0).alias("salt"), "f")
    salt = F.when(F.col("hot_f").isNull(), 0).otherwise(F.pmod(F.xxhash64("phrase"), F.lit(SALTS)) + 1).cast("int")
    found = cuts.join(hot, ["lang", part], "left").withColumn("salt", salt).join(cold, ["lang", part, "salt"], "left")
    return found.withColumn(out, F.coalesce("hot_f", "f")).drop("hot_f", "salt", "f")


def weakest_cuts(extended: DataFrame, totals: DataFrame, share: int = SHARD_LEAST) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the lowest-scoring cut of every phrase.
    At most 3 * ``SHARD_SHARE`` parts occur more than ``share`` times."""
    length = F.size(F.split("phrase", " "))
    cuts = (extended.withColumn("k", F.explode(F.sequence(F.lit(1), length - 1)))
            .withColumn("head", _words_of("phrase", F.lit(1), F.col("k")))
            .withColumn("tail", _words_of("phrase", F.col("k") + 1, length)))
    hot = totals.where(F.col("f") > share)
    cuts = _look_up(_look_up(cuts, totals, hot, "head", "l"), totals, hot, "tail", "r")
    score = F.expr("cast(a as decimal(20,0)) * 2000000BD div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return (cuts.groupBy("lang", "phrase", "a").agg(best)
            .select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("bigint").alias("score")))


def subsumed_by(extended: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, most): the largest count of a longer phrase around ``phrase``.

    Phrases longer by one word decide: a phrase longer by two has one of those in
    between that occurs at least as often.  Extensions to the right are the
    stripe's own maximum, those to the left come from the other prefixes' entries."""
    right = totals.where("most is not null").select("lang", F.col("prefix").alias("phrase"), "most")
    left = extended.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), F.col("a").alias("most"))
    return right.unionByName(left).groupBy("lang", "phrase").agg(F.max("most").alias("most"))


def collocations(docs: DataFrame, least: int = 30, subsume_pct: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of every lang by score, count and phrase: lang, rank,
    phrase, a, l, r, n, score.

    The best of every lang are taken in two steps, first within 64 hash buckets."""
    totals, extended, per_lang, share = phrases(docs, least)
    scored = weakest_cuts(extended.drop("prefix", "next"), totals, share)
    around = subsumed_by(extended, totals)
    kept = (scored.join(around, ["lang", "phrase"], "left")
            .where(F.col("most").isNull() | (100 * F.col("most") < subsume_pct * F.col("a"))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order)))
    kept = kept.where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return (kept.where(F.col("rank") <= top).join(F.broadcast(per_lang), "lang")
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
