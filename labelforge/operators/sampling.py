"""Sampling, ordering and de-duplication.

Seeded randomness is a hash of the row key and the seed (md5), so results do
not depend on partitioning or on the number of tasks.  Every per-class or
global rank goes through the bucketed helpers in ``ranking`` so that a hot
class is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.operators.ranking import bucketed_row_number, hash_bucket, ordered_buckets


def seeded_hash(key, seed: int = spec.SEED) -> Column:
    """Hex md5 of ``<key>:<seed>`` (the sort key of every seeded ordering)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))


def head_n(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """First ``n`` records by the source order key (top-k per partition, then merged)."""
    return df.orderBy(order_col).limit(n)


def row_ids(df: DataFrame, order_col: str, out_col: str = "row_id", start: int = 0) -> DataFrame:
    """Running number from ``start`` in ``order_col`` order, without one global task."""
    ranked = bucketed_row_number(ordered_buckets(df, [], [order_col]), [], [order_col], "_lf_b", "_lf_rank")
    return ranked.withColumn(out_col, F.col("_lf_rank") - 1 + F.lit(start)).drop("_lf_rank", "_lf_b")


def shuffle_rank(df: DataFrame, key_col: str, seed: int = spec.SEED,
                 out_col: str = "shuffle_rank") -> DataFrame:
    """Position (0-based) of each row in a seeded full shuffle."""
    h = seeded_hash(key_col, seed)
    with_h = df.withColumn("_lf_h", h)
    ranked = bucketed_row_number(with_h, [], ["_lf_h", key_col], hash_bucket(F.col("_lf_h")), "_lf_rank")
    return ranked.withColumn(out_col, F.col("_lf_rank") - 1).drop("_lf_h", "_lf_rank")


def shuffled(df: DataFrame, key_col: str, seed: int = spec.SEED) -> DataFrame:
    """The rows in seeded-shuffle order (range-partitioned sort, no single task)."""
    return df.orderBy(seeded_hash(key_col, seed), F.col(key_col))


def class_counts(df: DataFrame, class_col: str) -> DataFrame:
    """Value counts of one column, largest first (map-side combined)."""
    return df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), class_col)


def balance_classes(df: DataFrame, class_col: str, key_col: str, seed: int = spec.SEED,
                    classes: list | None = None) -> DataFrame:
    """Undersample every class to the size of the smallest class.

    Rows of a class are kept in seeded-hash order; classes outside ``classes``
    (when given) are dropped first.  Class sizes come from the small
    per-(class, bucket) count table of the rank, so the input is read once.
    """
    if classes is not None:
        df = df.where(F.col(class_col).isin(*classes))
    h = df.withColumn("_lf_h", seeded_hash(key_col, seed))

    def quota(offsets: DataFrame) -> DataFrame:
        # One row: the size of the smallest class.
        return offsets.join(F.broadcast(offsets.agg(F.min("_lf_total").alias("_lf_quota"))))

    ranked = bucketed_row_number(h, [class_col], ["_lf_h", key_col], hash_bucket(F.col("_lf_h")),
                                 "_lf_rank", with_offsets=quota)
    kept = ranked.where(F.col("_lf_rank") <= F.col("_lf_quota"))
    return kept.drop("_lf_h", "_lf_rank", "_lf_quota")


def stratum_key(*cols) -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in cols])


def split_quotas(counts: DataFrame, stratum_col: str, val_size: float = spec.VAL_SIZE,
                 order_col: str | None = None) -> DataFrame:
    """Training rows per stratum for a stratified split.

    n_val = ceil(val_size * N); training rows n_train = N - n_val are shared
    out in proportion to the stratum sizes by largest remainder (ties: the
    smaller ``order_col``, then stratum key first).  ``counts`` has one row per
    stratum (``n``).
    """
    everything = Window.partitionBy()
    c = counts.withColumn("_lf_N", F.sum("n").over(everything))
    c = c.withColumn("_lf_ntrain", F.col("_lf_N") - F.ceil(F.lit(float(val_size)) * F.col("_lf_N")))
    # n * n_train overflows 64 bits beyond ~3e9 rows per side: exact decimals.
    dec = "decimal(38,0)"
    prod = F.col("n").cast(dec) * F.col("_lf_ntrain").cast(dec)
    big_n = F.col("_lf_N").cast(dec)
    c = c.withColumn("_lf_rem", (prod % big_n).cast(dec)) \
        .withColumn("_lf_floor", ((prod - F.col("_lf_rem")) / big_n).cast("bigint"))
    c = c.withColumn("_lf_need", F.col("_lf_ntrain") - F.sum("_lf_floor").over(everything))
    order = Window.orderBy(F.desc("_lf_rem"), F.col(order_col or stratum_col), F.col(stratum_col))
    c = c.withColumn("_lf_pos", F.row_number().over(order))
    train = F.col("_lf_floor") + F.when(F.col("_lf_pos") <= F.col("_lf_need"), 1).otherwise(0)
    return c.select(stratum_col, "n", train.cast("bigint").alias("n_train"))


def stratified_split(df: DataFrame, strata: list[str], key_col: str, val_size: float = spec.VAL_SIZE,
                     seed: int = spec.SEED, out_col: str = "split") -> DataFrame:
    """Add ``stratum`` and ``split`` ('train' / 'val').

    Stratum sizes and quotas are computed on the small per-(stratum, bucket)
    table of the rank, then joined to the rows with the rank offsets.
    """
    s = df.withColumn("_lf_h", seeded_hash(key_col, seed))

    def quotas(offsets: DataFrame) -> DataFrame:
        # Strata are told apart by their columns; the joined text only orders and labels them.
        sizes = offsets.groupBy("_lf_pk", *strata).agg(F.max("_lf_total").alias("n")) \
            .withColumn("_lf_text", stratum_key(*strata))
        q = split_quotas(sizes, "_lf_pk", val_size, "_lf_text").select("_lf_pk", "n_train")
        return offsets.join(q, "_lf_pk")

    ranked = bucketed_row_number(s, list(strata), ["_lf_h", key_col], hash_bucket(F.col("_lf_h")),
                                 "_lf_rank", with_offsets=quotas).withColumn("stratum", stratum_key(*strata))
    out = ranked.withColumn(out_col, F.when(F.col("_lf_rank") <= F.col("n_train"), "train").otherwise("val"))
    return out.drop("_lf_h", "_lf_rank", "n_train")


def dedup_first(df: DataFrame, text_col: str, key_col: str) -> DataFrame:
    """One row per distinct text: the one with the smallest key.

    A hash aggregate: a text repeated in a third of all rows is combined
    map-side before the shuffle, so no task receives the whole group.
    """
    return df.groupBy(text_col).agg(F.min(key_col).alias(key_col)).select(key_col, text_col)


def overlap(test: DataFrame, train: DataFrame, text_col: str) -> DataFrame:
    """Rows of ``test`` whose text also occurs in ``train`` (should be none)."""
    seen = train.select(F.sha2(F.col(text_col), 256).alias("_lf_th"), F.col(text_col).alias("_lf_t")) \
        .dropDuplicates(["_lf_th", "_lf_t"])
    t = test.withColumn("_lf_th", F.sha2(F.col(text_col), 256))
    hit = t.join(seen, (t["_lf_th"] == seen["_lf_th"]) & (t[text_col] == seen["_lf_t"]), "left_semi")
    return hit.drop("_lf_th")
