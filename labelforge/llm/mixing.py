"""Mixing sources to target weights with a time-varying curriculum.

Every source has a linear weight schedule over the training clock ``t`` in
[0, 1].  Its integral is the source's cumulative token demand; inverting that
at a document's offset within its source (in a hashed order) gives the clock
time at which the document is read.  Documents are then range-sorted by it.

Offsets are prefix sums that never gather a source in one task: sizes are
summed per (source, hash bucket) with map-side combining, the small bucket
table gets running totals, and only the rows of one bucket are scanned together.

Edge cases: null text has size 0; a null source is a source of its own, ordered
last; empty tables give no rows; repeated rows are documents of their own;
columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import stage, word_count

WEIGHTS = (3.0, 1.0, 2.0)
#: (weight at t=0, weight at t=1) by source rank, repeating: steady, early, late.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
BUCKETS = 2048


def _cycle(values: Sequence, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
                   max_repeat: float = 2.0) -> DataFrame:
    """(source, rank, source_size, target): targets by weight, none above
    ``max_repeat`` times its source, the excess reshared by weight.

    Resharing until none is above ends at ``min(cap, level * weight)`` for one
    common level: over the sources ordered by cap / weight, the level that the
    rest of the words gives to the rest of the weights, at the first source that
    it doesn't cap (levels fall from there on).  One row per source (not per document) is in that scan.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("rank", F.row_number().over(by_name) - 1)
           .withColumn("weight", _cycle([float(w) for w in weights], F.col("rank")))
           .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    per = (per.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
           .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                       / F.sum("weight").over(after))
           .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
                       .over(everything)))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("source", "rank", "source_size", target.alias("target"))


def demand_time(fraction: Column, start: Column, end: Column) -> Column:
    """Clock time at which a linear schedule start -> end has asked for
    ``fraction`` of its integral."""
    slope = end - start
    root = F.sqrt(start * start + slope * (start + end) * fraction)
    return F.when(F.abs(slope) < 1e-12, fraction).otherwise((root - start) / slope)


def curriculum(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_repeat: float = 2.0,
               schedules: Sequence[tuple[float, float]] = SCHEDULES, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: its size, its source's size and target, the words
    that the mix takes of it and the clock times of its readings.

    A source whose target is ``e`` times its size is read ``floor(e)`` times in
    full and once more up to the rest of the target, in the hashed order; the
    sum of ``taken`` misses the target by at most half a document.
    """
    h = F.xxhash64("doc_id", F.lit("order"))
    sizes = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                              h.alias("h"), F.xxhash64("text").alias("tie"),
                              F.pmod(F.shiftright(h, 32), F.lit(buckets)).cast("int").alias("bucket")), "mix")
    per_source = source_targets(sizes, weights, share, max_repeat)
    per_bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = (per_bucket.withColumn("base", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
                  .select("source", "bucket", "base"))
    a, b = sizes.alias("a"), per_bucket.alias("b")
    rows = (a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket")))
            .select("a.*", "b.base"))
    inside = (Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("offset", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    s = per_source.alias("s")
    rows = (rows.alias("r").join(s, F.col("r.source").eqNullSafe(F.col("s.source")))
            .select("r.doc_id", "r.source", "r.size", "r.offset", "s.source_size", "s.target",
                    _cycle([float(x[0]) for x in schedules], F.col("s.rank")).alias("w0"),
                    _cycle([float(x[1]) for x in schedules], F.col("s.rank")).alias("w1")))
    epochs = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    rows = (rows.withColumn("full", F.floor(epochs))
            .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")))
    more = (F.col("size") > 0) & (F.col("offset") + F.col("size") / 2 <= F.col("rest"))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("full") + more.cast("bigint"))
                           .otherwise(F.lit(0)).cast("int"))
    clock = lambda i: demand_time(
        F.least(F.lit(1.0), (i * F.col("source_size") + F.col("offset")) / F.col("target")), F.col("w0"), F.col("w1"))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), clock)) \
        .otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), positions.alias("positions"))


def training_order(mix: DataFrame) -> DataFrame:
    """The readings in training order: (position, doc_id, source, size), one row
    per reading, range-partitioned and sorted by position."""
    return (mix.select(F.explode("positions").alias("position"), "doc_id", "source", "size")
            .orderBy("position", "doc_id"))


def mixed_documents(mix: DataFrame) -> DataFrame:
    """The digest of the mix per document, sorted by the first reading (those
    never read last)."""
    return (mix.select("doc_id", "size", "source_size", "target", "taken", "source",
                       F.get("positions", F.lit(0)).alias("position"), F.size("positions").alias("copies"))
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))
