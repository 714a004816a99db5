"""Skew-safe ordered scans.

``row_number() OVER (PARTITION BY p ORDER BY o)`` puts every row of one ``p``
into one task; a hot group (say a third of all rows) then runs on a single
core and may spill for hours.  The helpers here compute the same numbers from
two levels:

1. a *bucket* column that is monotone in the order: a hash prefix when the
   order is a hash, a block of epochs, or the range partition of the full
   order key (``ordered_buckets``).  Rows without an order value share bucket
   -1 and come first, like nulls in an ascending order;
2. the rows with their bucket, written once below the shared checkpoint folder
   (this cuts the lineage, so a lost executor never re-runs the upstream plan);
3. from that stage, a window over (p, bucket) gives the in-bucket part, and
   a map-side aggregate gives the bucket totals (one row per (p, bucket):
   small); an exclusive prefix over buckets on that small table is joined
   back on (p, bucket), the key by which the window has already dealt the rows.

The plan is the same at every size and for every catalog.  The upstream plan
runs once; results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.session import scratch_path

_AGG = {"min": F.min, "max": F.max, "sum": F.sum}


def _materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


RANGE_BYTES = 64 << 20  # bytes of a stage per range partition


def ordered_buckets(df: DataFrame, partition_cols: list[str], order_cols: list[str],
                    out_col: str = "_lf_b", range_bytes: int | None = None) -> DataFrame:
    """Add a bucket that grows with ``order_cols`` within ``partition_cols``.

    The staged rows are range-partitioned by both, so buckets hold about equally
    many rows however the values are spread: an outlier, a burst in one second
    or a key with most of the rows is cut like any other stretch.  Only rows
    that agree in every order column cannot be told apart.  Bounds are sampled
    from the stage, so the upstream plan runs once.
    """
    staged = _materialized(df)
    spark = df.sparkSession
    size = int(str(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(spark.sparkContext.defaultParallelism, -(-size // (range_bytes or RANGE_BYTES)))
    return staged.repartitionByRange(n, *partition_cols, *order_cols).withColumn(out_col, F.spark_partition_id())


def _group_key(df: DataFrame, partition_cols: list[str]) -> tuple[DataFrame, list[str]]:
    """A non-null surrogate for the partition columns.

    ``to_json(struct(...))`` is injective and never null (a null field is
    left out), so plain equality on it groups exactly like the window's
    PARTITION BY, nulls included.  Plain equi-join keys keep the checkpoint's
    hash partitioning usable by a sort-merge join: the big side is not
    shuffled again (a null-safe join key would force that).
    """
    if not partition_cols:
        return df, []
    return df.withColumn("_lf_pk", F.to_json(F.struct(*[F.col(c) for c in partition_cols]))), ["_lf_pk"]


def hash_bucket(hex_hash: Column, digits: int = 4) -> Column:
    """Leading ``digits`` hex digits of a hex hash as an int (16**digits buckets;
    only non-empty buckets ever appear in the bucket tables)."""
    return F.conv(F.substring(hex_hash, 1, digits), 16, 10).cast("int")


def _with_bucket(df: DataFrame, bucket) -> tuple[DataFrame, str, bool]:
    # Rows without an order value keep a bucket of their own, before the others.
    if isinstance(bucket, str):
        return df.withColumn(bucket, F.coalesce(F.col(bucket), F.lit(-1))), bucket, False
    return df.withColumn("_lf_b", F.coalesce(bucket, F.lit(-1))), "_lf_b", True


def bucketed_row_number(df: DataFrame, partition_cols: list[str], order_cols: list,
                        bucket, out_col: str = "rank",
                        with_offsets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``row_number()`` (1-based) over ``partition_cols`` ordered by ``order_cols``.

    ``bucket`` (a column expression, or the name of an existing column) must
    be non-decreasing along ``order_cols`` inside a partition.
    ``with_offsets`` may add columns to the small per-(partition, bucket)
    table (it sees ``_lf_n`` = rows in the bucket and ``_lf_total`` = rows
    in the partition); they are joined to every row.  The input is staged
    eagerly, so select only the columns needed downstream before calling.
    """
    b, bcol, own = _with_bucket(df, bucket)
    b, pk = _group_key(b, list(partition_cols))
    keys = pk + [bcol]
    b = _materialized(b)
    ranked = b.withColumn("_lf_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols)))
    counts = b.groupBy(*keys, *partition_cols).agg(F.count(F.lit(1)).alias("_lf_n"))
    before = Window.partitionBy(*pk).orderBy(bcol).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *partition_cols, "_lf_n",
                            F.coalesce(F.sum("_lf_n").over(before), F.lit(0)).alias("_lf_off"),
                            F.sum("_lf_n").over(Window.partitionBy(*pk)).alias("_lf_total"))
    if with_offsets is not None:
        offsets = with_offsets(offsets)
    out = ranked.join(offsets.drop("_lf_n", "_lf_total", *partition_cols), keys, "inner")
    out = out.withColumn(out_col, (F.col("_lf_off") + F.col("_lf_local")).cast("bigint")) \
        .drop("_lf_off", "_lf_local", *pk)
    return out.drop(bcol) if own else out


def bucketed_prefix(df: DataFrame, partition_cols: list[str], order_cols: list,
                    bucket, value: Column, op: str, out_col: str,
                    inclusive: bool = True) -> DataFrame:
    """Running ``op`` (min/max/sum) of ``value`` in order, per partition.

    ``inclusive=False`` gives the aggregate over strictly earlier rows (null
    for the first row).  Nulls in ``value`` are ignored like in SQL.  Pass
    ``bucket`` as an existing column name to keep it (and the partitioning
    by it) for a following scan.
    """
    agg = _AGG[op]
    b, bcol, own = _with_bucket(df, bucket)
    b, pk = _group_key(b, list(partition_cols))
    keys = pk + [bcol]
    b = _materialized(b.withColumn("_lf_v", value))
    upto = 0 if inclusive else -1
    scanned = b.withColumn("_lf_local", agg("_lf_v").over(
        Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, upto)))
    per_bucket = b.groupBy(*keys).agg(agg("_lf_v").alias("_lf_bv"))
    before = Window.partitionBy(*pk).orderBy(bcol).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, agg("_lf_bv").over(before).alias("_lf_carry"))
    out = scanned.join(carry, keys, "inner").drop(*pk)
    if op == "sum":
        combined = F.when(F.col("_lf_carry").isNull() & F.col("_lf_local").isNull(), F.lit(None)) \
            .otherwise(F.coalesce(F.col("_lf_carry"), F.lit(0)) + F.coalesce(F.col("_lf_local"), F.lit(0)))
    elif op == "min":
        combined = F.least(F.col("_lf_carry"), F.col("_lf_local"))
    else:
        combined = F.greatest(F.col("_lf_carry"), F.col("_lf_local"))
    out = out.withColumn(out_col, combined).drop("_lf_v", "_lf_carry", "_lf_local")
    return out.drop(bcol) if own else out
