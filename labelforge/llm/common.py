"""Helpers shared by the operators: columns, hashes, stages, batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.session import scratch_path

#: Delimiters of ``[^\x20\x09-\x0D]+`` words, as a Java pattern.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A word of that kind.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the session's shared checkpoint folder and
    read it back: lineage is cut, later readers prune columns, and a lost
    executor costs no recomputation of what came before.

    A task holds a row group as a whole when it writes or reads one;
    ``group_bytes`` is its size (else Spark's own)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """Hint a broadcast while the counted rows times ``row_bytes`` stay within
    ``most``; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it new to ``df``."""
    while name in df.columns:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words (null text: 0), as bigint."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD)).cast("bigint")


def fold(key, modulus: int) -> int:
    """crc32 of the id written as text, modulo ``modulus`` (null id: 0)."""
    return 0 if key is None else zlib.crc32(str(key).encode()) % modulus


def fold_column(key: Column, modulus: int) -> Column:
    """The same fold as a column."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that working arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_by_size(batches: Iterator[pa.RecordBatch], column: str, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``rows`` rows whose ``column`` holds
    about ``most`` bytes (a single row may hold more)."""
    for batch in batches:
        sizes = [0 if v.as_buffer() is None else v.as_buffer().size for v in batch[column]]
        at = held = 0
        for i, size in enumerate(sizes):
            if i > at and (held + size > most or i - at >= rows):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        if batch.num_rows > at:
            yield batch.slice(at)


def gathered(df: DataFrame, key: str, *lists: str) -> tuple[pa.Table, list[list[np.ndarray]]]:
    """A bounded result on the driver, in order of ``key``: the Arrow table and,
    for each list column, its rows as views of one array."""
    table = df.toArrow().combine_chunks().sort_by(key).combine_chunks()
    out = []
    for name in lists:
        column = table[name].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
        if not len(column):
            out.append([])
            continue
        values, ends = column.values.to_numpy(), column.offsets.to_numpy()
        out.append([values[a:b] for a, b in zip(ends[:-1], ends[1:])])
    return table, out


def word_runs(blob: bytes, delimiters: bytes) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The words of UTF-8 text between single-byte ASCII delimiters, and where each
    starts and ends."""
    table = np.ones(256, bool)
    table[list(delimiters)] = False
    data = np.frombuffer(blob, np.uint8)
    inside = table[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words, starts, ends


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective) on an array of unsigned longs."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def logistic(x):
    """1 / (1 + exp(-x)), safe for large arguments."""
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled documents (doc_id, text, label), by the
    smallest hash of the id, one row an id: a bounded sample that reruns agree on.
    The drawn ids are broadcast, ``max_rows`` of them at most.

    ``max_rows`` bounds what a model fit reads; scoring reads every row.
    """
    marked = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & keep)
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select("doc_id", "text").where(keep).join(F.broadcast(marked), "doc_id")
    return one_per_id(rows)


def one_per_id(rows: DataFrame) -> DataFrame:
    """One row of (doc_id, text, label) per id, the smallest text: an id that stands
    in the table many times counts once in a bounded sample."""
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def in_filter(rows: DataFrame, ids: DataFrame, key: str, slots: int = 1 << 20) -> DataFrame:
    """The rows whose ``key`` may be in ``ids``: at most ``slots`` hash slots are
    broadcast, whatever the number of ids; rows of other ids that share a slot stay."""
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
    held = ids.select(slot.alias("_slot")).distinct()
    return rows.withColumn("_slot", slot).join(F.broadcast(held), "_slot", "left_semi").drop("_slot")
