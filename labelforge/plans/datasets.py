"""Composite dataset pipelines (D1-D8) built from the operators.

``post_dataset``: single-label posts (crosswalked) and conversation turns
labelled by their largest score are fused, restricted to the targets, balanced,
placed in a seeded shuffle order, translated and emitted once per language.

``mail_dataset``: raw mails are cleaned, empty and duplicate texts dropped,
numbered, annotated N times (materialised), voted, translated and emitted
once per language with the vote columns.

The rows come from the providers of ``sources/providers``.  With ``stage_dir``
every stage is saved and reused while its inputs and settings are the same
(``ensure_stage``); without it the plan stays lazy.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.functions import labels as lab
from labelforge.functions import text as tx
from labelforge.operators import annotate as ann
from labelforge.operators import sampling as smp
from labelforge.sources import files as fio
from labelforge.sources.providers import MAILS, POSTS, SCORED_TURNS, DatasetProvider, open_dataset
from labelforge.sources.tables import table_path

# Turn numbers are 32-bit, so a turn's place in its conversation takes this many values.
TURNS = 2 ** 32


def _stage(spark, stage_dir, name, build, required, predicate=None, inputs=(), **settings) -> DataFrame:
    """``inputs`` are the paths that the stage reads."""
    if stage_dir is None:
        return build()
    return fio.ensure_stage(spark, os.path.join(stage_dir, name), build, required, predicate, inputs, settings)


def _tables(sf_dir: str, *providers: DatasetProvider) -> list[str]:
    return [table_path(sf_dir, name) for p in providers for name in p.tables]


def _earlier(stage_dir, name) -> list[str]:
    return [] if stage_dir is None else [os.path.join(stage_dir, name)]


def _named(client) -> str:
    return f"{getattr(client, '__module__', '')}.{getattr(client, '__qualname__', type(client).__qualname__)}"


def both_languages(df: DataFrame, keep: list[str], en_col: str, de_col: str) -> DataFrame:
    """One row per language from one input row (single pass, no union)."""
    rows = F.array(F.struct(F.lit("en").alias("language"), F.col(en_col).alias("content")),
                   F.struct(F.lit("de").alias("language"), F.col(de_col).alias("content")))
    return df.select(*keep, F.explode(rows).alias("_lf_r")).select(*keep, "_lf_r.language", "_lf_r.content")


def fused_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both sources with an ``item_id`` that no two rows share: even numbers are
    documents, odd ones turns; 38 digits hold every 64-bit id."""
    def wide(c: str):
        return F.col(c).cast("decimal(20,0)")

    a = open_dataset(POSTS, spark, sf_dir).withColumn("emotion", lab.crosswalk("sentiment")) \
        .dropna(subset=["emotion"]) \
        .select((wide("doc_id") * 2).cast("decimal(38,0)").alias("item_id"), "text", "emotion",
                F.lit("crowdflower").alias("source"))
    b = lab.dominant_label(open_dataset(SCORED_TURNS, spark, sf_dir), "emotion").select(
        ((wide("conv_id") * F.lit(TURNS) + wide("turn")) * 2 + 1).cast("decimal(38,0)").alias("item_id"), "text",
        "emotion", F.lit("cbet").alias("source"))
    return a.unionByName(b, allowMissingColumns=True).where(F.col("emotion").isin(*spec.TARGET_LABELS))


def post_dataset(spark: SparkSession, sf_dir: str, balance: bool = True, stage_dir: str | None = None,
                 client: ann.TranslateClient = ann.stub_translate_client,
                 keep_failed: bool = True) -> DataFrame:
    """Posts in both languages.  ``keep_failed=False`` drops rows whose
    translation failed (by default they are kept with the placeholder text)."""
    def english() -> DataFrame:
        fused = fused_posts(spark, sf_dir)
        if balance:
            fused = smp.balance_classes(fused, "emotion", "item_id", classes=spec.TARGET_LABELS)
        return smp.shuffle_rank(fused.withColumn("language", F.lit("en")), "item_id", out_col="position")

    en = _stage(spark, stage_dir, "posts_en", english, ["text", "emotion", "language"],
                F.col("language") == "en", _tables(sf_dir, POSTS, SCORED_TURNS), balance=balance)

    def translated() -> DataFrame:
        t = ann.translate(en, "item_id", "text", client, prompts=ann.POST_PROMPTS)
        return t if stage_dir is not None else ann.materialize(t)  # calls happen once

    tr = _stage(spark, stage_dir, "posts_translated", translated, ["translated_text"],
                inputs=_earlier(stage_dir, "posts_en"), client=_named(client))
    if not keep_failed:
        tr = tr.where(F.col("success"))
    tr = tr.withColumn("item_id", F.col("item_id").cast("string"))
    return both_languages(tr, ["item_id", "position", "emotion", "source"], "text", "translated_text")


def mail_dataset(spark: SparkSession, sf_dir: str, stage_dir: str | None = None,
                 client: ann.AnswerClient = ann.stub_answer_client,
                 translator: ann.TranslateClient = ann.stub_translate_client,
                 attempts: int = spec.NUM_ATTEMPTS, keep_failed: bool = True) -> DataFrame:
    """Mails in both languages with the vote columns (see module docstring)."""
    def cleaned() -> DataFrame:
        raw = open_dataset(MAILS, spark, sf_dir)
        c = tx.drop_empty(tx.clean_mail(raw, "text", "preprocessed_text"), "preprocessed_text")
        first = smp.dedup_first(c.select("doc_id", "preprocessed_text"), "preprocessed_text", "doc_id")
        return smp.row_ids(first, "doc_id", out_col="email_id")

    mails = _stage(spark, stage_dir, "mail_clean", cleaned, ["preprocessed_text"], inputs=_tables(sf_dir, MAILS))

    def labelled() -> DataFrame:
        a = ann.annotate(mails.select("email_id", "preprocessed_text"), "email_id", "preprocessed_text",
                         client, attempts)
        a = a if stage_dir is not None else ann.materialize(a)
        return ann.vote(a, "email_id", attempts).withColumn("language", F.lit("en"))

    voted = _stage(spark, stage_dir, "mail_labelled", labelled, ["language", "emotion"],
                   F.col("language") == "en", _earlier(stage_dir, "mail_clean"), client=_named(client),
                   attempts=attempts)

    def translated() -> DataFrame:
        t = ann.translate(voted, "email_id", "preprocessed_text", translator)
        return t if stage_dir is not None else ann.materialize(t)  # calls happen once

    tr = _stage(spark, stage_dir, "mail_translated", translated, ["translated_text"],
                inputs=_earlier(stage_dir, "mail_labelled"), client=_named(translator))
    if not keep_failed:
        tr = tr.where(F.col("success"))
    label_cols = ["emotion", "confidence", "emotion_counts"] + [f"emotion_attempt_{i + 1}" for i in range(attempts)]
    return both_languages(tr, ["email_id"] + label_cols, "preprocessed_text", "translated_text")
