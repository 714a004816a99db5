"""Parallelism for CPU-bound row work.

Regex cleaning, model-client calls and batch encoding cost far more per row
than a shuffle of the row.  When a scan yields fewer splits than the session
has cores (a small file with one row group), the rows are spread round-robin
over ``defaultParallelism`` partitions first.  On a large input the scan
already has many more splits than cores and nothing is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_ROWS, SLICE_BYTES = 1024, 2 << 20   # rows and text that a task's Python works on at once


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, slice) of an Arrow batch: at most ``SLICE_ROWS`` rows whose ``column``
    holds at most ``SLICE_BYTES`` (a single row may hold more)."""
    at = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()):
        if i > at and (held + size > SLICE_BYTES or i - at >= SLICE_ROWS):
            yield at, batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if batch.num_rows > at:
        yield at, batch.slice(at)


def source_splits(df: DataFrame) -> int:
    """Splits of the largest source, from file sizes and partition counts; runs
    no job and no shuffle stage."""
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    most = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName() == "LogicalRDD" or "ExistingRDD" in leaf.nodeName():
            most = max(most, leaf.rdd().getNumPartitions())
        else:
            most = max(most, int(leaf.stats().sizeInBytes()) // split)
    return most


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    if df.isStreaming:  # micro-batches keep the source's partitioning
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df if source_splits(df) >= target else df.repartition(target)
