"""The training-data pipeline: quality rules, near-duplicates, benchmark
decontamination, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of their input.  ``docs`` must have doc_id, text and, for the mix,
source; other columns are carried along whatever their names.

Rows are told apart by a hash of doc_id and text, so null and repeated ids are
safe.  Empty input gives empty output of the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm import decontaminate, mixing, near_duplicates, quality_rules, secrets
from labelforge.llm.common import free_name, maybe_broadcast, stage
from labelforge.session import prepare
from labelforge.sources.tables import table


def _key(text: Column) -> Column:
    return F.xxhash64("doc_id", text)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    prepare(spark)
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest
    doc_id, once."""
    prepare(spark)
    k = free_name(docs, "k")
    found = near_duplicates.groups(docs).where("kept").select(_key(F.col("tie")).alias(k)).distinct()
    keyed = docs.withColumn(k, _key(F.xxhash64("text")))
    return keyed.join(found, k, "left_semi").dropDuplicates([k]).select(*docs.columns)


def decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    prepare(spark)
    k = free_name(docs, "k")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    found = stage(found.select(_key(F.col("tie")).alias(k)).distinct(), "contaminated")
    keyed = docs.withColumn(k, _key(F.xxhash64("text")))
    return keyed.join(maybe_broadcast(found, 32), k, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mask."""
    prepare(spark)
    k, spans = free_name(docs, "k"), free_name(docs, "spans")
    found = secrets.secret_spans(docs).where(F.size("spans") > 0)
    found = stage(found.select(_key(F.col("tie")).alias(k), F.col("spans").alias(spans)).dropDuplicates([k]), "secrets")
    size = found.agg(F.sum(F.size(spans) * 64 + 64)).first()[0] or 0
    keyed = docs.withColumn(k, _key(F.xxhash64(F.coalesce("text", F.lit("")))))
    out = keyed.join(F.broadcast(found) if size <= 32 << 20 else found, k, "left")
    out = out.withColumn("text", F.when(F.col(spans).isNotNull(), secrets.masked(F.col("text"), F.col(spans)))
                         .otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text"))
                             .otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of every document and its place in training, in that order."""
    prepare(spark)
    return mixing.mixed_documents(mixing.curriculum(docs))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontaminate", decontam),
          ("mask_secrets", mask_secrets), ("mix_sources", mix_sources)]

#: Boosted trees can't be written as SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
