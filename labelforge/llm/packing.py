"""Packing documents into token sequences along a space-filling curve.

Every document gets a vector of hashed words, projected to three dimensions.  The
place of that point on a Hilbert curve is its key: documents that are near on the
curve share words.  Documents are range-sorted by the key and laid end to end;
the line is cut every ``length`` ids, so neighbours on the curve share sequences
and only the last sequence holds padding.

A text is tokenized once, by its distinct parts: the tokenizer drops white space and
joins no letters, digits and punctuation.  The ids travel as
bytes through one range shuffle; the place of a document on the line is its place
within its range partition plus the sizes of the partitions before it, one small
row a partition.

Edge cases: null and empty texts are the end id alone; a document longer than a
sequence is cut into pieces; repeated rows and null or repeated ids are documents
of their own; equal keys are ordered by the row's number in the staged input; an
empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import codecs
import itertools
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import slices_by_size, stage

LENGTH = 4096
END = 2
BUCKETS, DIMS, BITS = 256, 3, 20   # hashed words, dimensions of the curve, bits of each
CACHE = 1 << 17                    # parts of texts whose ids a worker keeps
WORDS = 1000                       # new words the tokenizer's model gets at once
RANGE_IDS = 8 << 20                # ids a range partition
GROUP_BYTES = 16 << 20             # a row group of the staged rows
PAD = 0
SLICE_BYTES = 1 << 20             # texts or ids a task works on at once


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """Class of a byte where it says for certain what its character is: 1 letter,
    2 digit, 3 punctuation, 0 anything else (the apostrophe begins an ending)."""
    out = np.zeros(256, np.int8)
    out[list(range(65, 91)) + list(range(97, 123))] = 1
    out[48:58] = 2
    out[[c for c in range(33, 127) if not out[c] and c != 39]] = 3
    return out


CLASSES = _classes()
INSIDE = np.ones(256, bool)   # bytes of a part: all but white space
INSIDE[list(b" \n\t\r")] = False


def kinds(data: np.ndarray) -> np.ndarray:
    """Class of every byte, with both bytes of a Latin-1 letter as letters."""
    kind = CLASSES[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]   # the signs of times and division
    kind[lead] = kind[lead + 1] = 1
    return kind


def parts(blob: bytes, specials: list[bytes]) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces of a text that the tokenizer looks at one by one, and where each
    starts: cut at white space, around digits and between letters and punctuation.

    No cut is made beside a character that is not ASCII or a Latin-1 letter, as it
    may join its neighbours, nor inside a special token."""
    data = np.frombuffer(blob, np.uint8)
    kind = kinds(data)
    inside = INSIDE[data]
    cut = np.zeros(len(data) + 1, bool)
    both = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    cut[1:-1] = both
    for special in specials:
        at = blob.find(special)
        while at >= 0:
            cut[at + 1:at + len(special)] = False
            at = blob.find(special, at + 1)
    bounds = np.flatnonzero(np.diff(inside, prepend=False, append=False) | cut)
    begins = np.flatnonzero(inside[bounds[:-1]])       # the last bound is an end
    starts = bounds[begins]
    ends = np.append(0, np.cumsum(bounds[begins + 1] - starts)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[inside])), starts


class Encoder:
    """Ids of the parts of texts: part i has ``size[i]`` ids from ``begin[i]`` on in
    ``flat``; part 0 is the end id.

    Parts of letters alone go to the tokenizer's model as lower-case byte letters
    (what its normalizer and pattern make of them), many at once, and are told apart
    by their last ids; all others go through the whole tokenizer."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = max(self.tokenizer.get_vocab_size(), end + 1) > 1 << 16
        bytewise = self.tokenizer.pre_tokenizer[1]
        letters = [chr(b) for b in range(256)]
        for low in range(64):
            letters[0xC3], letters[0x80 + low] = bytewise.pre_tokenize_str(chr(0xC0 + low))[0][0]
        self.letters = "".join(letters)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix, vocabulary = self.words.model.end_of_word_suffix, self.words.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([""])
        self.flat, self.begin, self.size = np.array([self.end], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.hashes = np.zeros(1, np.int64)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of lower-case words of letters."""
        text = codecs.charmap_decode(b" ".join(words), "strict", self.letters)[0]
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) == len(words):   # a word has at most one such id, its last
            return ids, np.diff(ends, prepend=-1)
        return _joined(self.words.encode_batch_fast(text.split(" "), add_special_tokens=False))

    def encode(self, new: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each, hash of each in lower case) of parts."""
        at = np.frombuffer(new.buffers()[1], np.int32)[new.offset:new.offset + len(new) + 1]
        data = np.frombuffer(new.buffers()[2], np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        whole = np.logical_and.reduceat(kinds(data) == 1, at[:-1])
        lower = np.insert(data, at[1:], 10).tobytes().decode().lower().encode().split(b"\n")[:-1]   # no part holds a line end
        words = list(itertools.compress(lower, whole))
        found = [self.encode_words(words[i:i + WORDS]) for i in range(0, len(words), WORDS)]
        rest = new.filter(pa.array(~whole)).to_pylist()
        if rest:
            found.append(_joined(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)))
        ids, sizes = (np.concatenate(x) for x in zip(*found))
        place = np.argsort(~whole, kind="stable")      # of the parts in the order found
        size = np.empty(len(new), np.int64)
        size[place] = sizes
        word = np.repeat(whole, size)
        flat = np.empty(len(ids), np.uint32)
        flat[word], flat[~word] = np.split(ids, [word.sum()])
        return flat, size, np.fromiter(map(zlib.crc32, lower), np.int64, len(new))

    def numbers(self, words: pa.StringArray) -> np.ndarray:
        """Numbers of the parts; new ones are tokenized."""
        if len(self.known) > CACHE:
            self.forget()
        if not len(words):
            return np.zeros(0, np.int32)
        coded = pa.chunked_array([self.known, pa.array(words, pa.string())]).dictionary_encode()
        every = coded.chunk(1).dictionary
        new = every[len(self.known):]
        if len(new):
            ids, sizes, hashes = self.encode(new)
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(sizes) - sizes)
            self.flat, self.size = np.append(self.flat, ids), np.append(self.size, sizes)
            self.hashes, self.known = np.append(self.hashes, hashes), every
        return coded.chunk(1).indices.to_numpy()


def _joined(found: list) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each) of the tokenizer's encodings."""
    ids = [e.ids for e in found]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, sizes.sum()), sizes


@lru_cache(maxsize=2)
def _encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (one row each), by Skilling's
    transposed form: undo the rotations from the highest bit down, Gray-code the
    axes, then interleave their bits."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            turned = (x[d] & bit) > 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def curve_keys(doc: np.ndarray, hashes: np.ndarray, docs: int) -> np.ndarray:
    """Hilbert keys of documents from the document and the hash of every word."""
    grid = np.bincount(doc * BUCKETS + hashes % BUCKETS, weights=1.0 - 2.0 * ((hashes >> 16) & 1),
                       minlength=docs * BUCKETS).reshape(docs, BUCKETS)
    grid = np.sign(grid) * np.sqrt(np.abs(grid))
    grid /= np.maximum(np.linalg.norm(grid, axis=1, keepdims=True), 1e-12)
    axes = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    place = 0.5 * (1.0 + np.tanh(0.8 * (grid @ axes)))
    return hilbert_key(np.minimum(place * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def tokenize(texts: list[str], encoder: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all ids in order, ids of each text with its end id, curve keys)."""
    raw = [t.encode() for t in texts]
    first = np.cumsum([0] + [len(r) + 1 for r in raw])
    words, starts = parts(b"\n".join(raw), encoder.specials)
    ends = np.searchsorted(starts, first[1:])          # words before the end of each text
    word = encoder.numbers(words)
    every = np.insert(word, ends, 0)
    each = encoder.size[every]
    upto = np.cumsum(each)
    ids = encoder.flat[np.arange(upto[-1]) + np.repeat(encoder.begin[every] - (upto - each), each)]
    counts = np.diff(upto[ends + np.arange(len(texts))], prepend=0)
    doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    return ids, counts, curve_keys(doc, encoder.hashes[word], len(texts))


def curve_documents(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, key, tokens, ids) of every document; the ids as little-endian
    integers of 2 bytes where the vocabulary has no more, else 4."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end)
        kind = "<u4" if encoder.wide else "<u2"
        for batch in slices_by_size(batches, "text", 1024, SLICE_BYTES):
            ids, counts, keys = tokenize(batch["text"].to_pylist(), encoder)
            ids = ids.astype(kind)
            ends = np.append(0, np.cumsum(counts) * ids.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(keys), pa.array(counts), packed],
                                             ["doc_id", "key", "tokens", "ids"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id {id_type}, key bigint, tokens bigint, ids binary")


def line_up(documents: DataFrame) -> DataFrame:
    """Range-sort the documents by key and add ``at``, the ids before each on the
    whole line.

    The input is staged first, so that the bounds' sample reads no text twice; the
    sorted rows are staged with their place within their range partition.  What a task
    sorts, writes and reads again is bounded by the ids of a range partition, counted
    as they are and not as they compress, and by small row groups."""
    staged = stage(documents.withColumn("row", F.monotonically_increasing_id()), "curve", GROUP_BYTES)
    total = staged.agg(F.sum("tokens")).first()[0] or 0
    ranges = max(documents.sparkSession.sparkContext.defaultParallelism, -(-total // RANGE_IDS))
    dealt = (staged.repartitionByRange(ranges, "key", "row").withColumn("part", F.spark_partition_id())
             .sortWithinPartitions("key", "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            tokens = batch["tokens"].to_numpy()
            yield batch.append_column("at", pa.array(before + np.cumsum(tokens) - tokens))
            before += int(tokens.sum())

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    laid = stage(dealt.mapInArrow(run, fields + ", at bigint"), "line", GROUP_BYTES)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (laid.groupBy("part").agg(F.sum("tokens").alias("tokens"))
             .select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base")))
    return (laid.join(F.broadcast(bases), "part")   # one row a range partition
            .select("doc_id", "tokens", "ids", (F.col("at") + F.col("base")).alias("at")))


def pieces(lined: DataFrame, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Cut the line every ``length`` ids: one row a piece, with its ids or, without
    them, their checksum only."""
    id_type = lined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_size(batches, "ids", 1024, SLICE_BYTES):
            tokens, at = batch["tokens"].to_numpy(), batch["at"].to_numpy()
            first = at // length
            number = (at + tokens - 1) // length - first + 1
            row = np.repeat(np.arange(len(tokens)), number)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            low = np.maximum(sequence * length, at[row])
            high = np.minimum((sequence + 1) * length, (at + tokens)[row])
            start = low - at[row]
            docs = [np.frombuffer(v.as_buffer(), "<u2" if v.as_buffer().size == 2 * t else "<u4").astype("<u4")
                    for v, t in zip(batch["ids"], tokens)]
            held = [docs[r][s:s + n] for r, s, n in zip(row, start, high - low)]
            columns = [batch["doc_id"].take(pa.array(row)), pa.array(start), pa.array(high - low),
                       pa.array([zlib.crc32(h) for h in held], pa.int64()), pa.array(tokens[row]), pa.array(sequence),
                       pa.array(low - sequence * length)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([h.astype(np.int32) for h in held], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = (f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids)
    return lined.mapInArrow(run, schema)


def sequences(cut: DataFrame, length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """(sequence_id, ids, used): the pieces of every sequence joined in order and
    padded to ``length``; a sequence holds at most ``length`` ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = cut.groupBy("sequence_id").agg(F.flatten(parts).alias("ids"))
    rest = F.array_repeat(F.lit(pad), length - F.size("ids"))
    return joined.select("sequence_id", F.concat("ids", rest).alias("ids"), F.size("ids").alias("used"))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END,
         with_ids: bool = True) -> DataFrame:
    """The pieces of all documents along the curve."""
    return pieces(line_up(curve_documents(docs, path or vocabulary(), end)), length, with_ids)
