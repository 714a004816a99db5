"""Derived inputs built from the driver tables.

Each function is one DataFrame plan over the parquet tables, so the work
grows with the data.  The same rows are defined in SQL for the DuckDB oracle
(``labelforge.plans.oracle``); both start from the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.operators import model as mdl
from labelforge.operators.ranking import bucketed_row_number, ordered_buckets
from labelforge.sources.tables import table

NL = "\n"

# Source-label vocabulary of the single-label posts: the crosswalked labels
# in crosswalk order, then the unmapped ones.
POST_VOCABULARY = [s for sources in spec.POST_CROSSWALK.values() for s in sources] + spec.POST_UNMAPPED


def raw_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents rendered as raw mails; the layout variant is ``doc_id % 11``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    v = F.col("doc_id") % 11
    head = F.concat(F.lit("Message-ID: <"), F.col("doc_id").cast("string"), F.lit(".mail>" + NL),
                    F.lit("X-FileName: inbox.nsf" + NL))
    t = F.col("text")
    tails = {
        3: F.concat(F.lit(NL + "------------" + NL), t),
        4: F.lit(NL + "Sent from my phone"),
        5: F.concat(F.lit(NL + "--- Forwarded by X ---" + NL), t),
        6: F.concat(F.lit(NL + NL + "Jane Doe" + NL + "01/02/2001 10:11 AM" + NL + "To: b" + NL
                          + "x" + NL + "To: c" + NL), t),
        7: F.concat(F.lit(NL * 4 + "P.S. "), t),
        8: F.concat(F.lit(NL + "This message is intended solely for you" + NL), t),
        9: F.concat(F.lit(NL + "CONFIDENTIALITY NOTICE "), t),
        10: F.lit(""),
    }
    body = F.concat(head, F.lit(NL), t)
    msg = F.when(v == 0, t).when(v == 1, F.concat(head, F.lit("skipped line" + NL), t)) \
        .when(v == 2, F.lit(""))
    for k, tail in tails.items():
        msg = msg.when(v == k, F.concat(body, tail))
    return d.select("doc_id", msg.alias("message"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-label posts: ``sentiment`` from the source tag number.

    ``src<i>`` gets vocabulary entry ``i % 13``, upper-cased for ``i >= 13``.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    vocab = F.array(*[F.lit(x) for x in POST_VOCABULARY])
    word = F.get(vocab, i % len(POST_VOCABULARY))
    return d.withColumn("sentiment", F.when(i >= len(POST_VOCABULARY), F.upper(word)).otherwise(word))


def scored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with six score columns between -4 and 6, made from the
    turn's place and length."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    return c.select("*", *[
        ((F.col("conv_id") * (i + 3) + F.col("turn") * (i + 1) + size * (2 * i + 1)) % 11 - 4).cast("double").alias(name)
        for i, name in enumerate(spec.SCORE_COLUMNS)])


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score-column posts: score i sums the embedding elements at the positions
    that leave the remainder i."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = len(spec.SCORE_COLUMNS)

    def score(i: int):
        mine = F.filter("embedding", lambda x, at: at % n == i)
        return F.aggregate(mine, F.lit(0.0), lambda acc, x: acc + x.cast("double"))

    cols = [score(i).alias(name) for i, name in enumerate(spec.SCORE_COLUMNS)]
    return e.select("vec_id", *cols)


#: Names of the ten classes of the embeddings.
VECTOR_LABELS = [str(i) for i in range(10)]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """true = label, pred = class of the most similar class mean, language by vec_id parity."""
    e = table(spark, sf_dir, "embeddings")
    return mdl.centroid_predict(e, mdl.centroids(e, "embedding", "label"), "embedding").select(
        "vec_id",
        F.col("label").cast("int").alias("true_label"),
        "pred_label",
        F.when(F.col("vec_id") % 2 == 0, "en").otherwise("de").alias("language"),
    )


def _k(props: str = "props"):
    return F.get_json_object(F.col(props), "$.k").cast("bigint")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training run per user; one epoch per event in (ts, event_id) order."""
    # parse k once, before staging: the stage then holds a number, not the JSON text
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", _k().alias("k"))
    bucketed = ordered_buckets(ev, ["user_id"], ["ts", "event_id"])
    ranked = bucketed_row_number(bucketed, ["user_id"], ["ts", "event_id"], "_lf_b", "_lf_rn")
    k = F.col("k")
    return ranked.drop("_lf_b").select(
        F.col("user_id").alias("run_id"),
        (F.col("_lf_rn") - 1).alias("epoch"),
        (F.col("value") / 2).alias("train_loss"),
        ((k % 10) / 10.0).alias("train_acc"),
        F.col("value").alias("val_loss"),
        (k / 100.0).alias("val_acc"),
        F.lit(1e-4).alias("learning_rate"),
        k.alias("n_samples"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitoring events: one per event row."""
    ev = table(spark, sf_dir, "events")
    k = _k()
    return ev.select(
        F.col("event_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("context_name"),
        F.when(F.col("event_type") == "error", "model_load").otherwise("inference_run").alias("event_type"),
        F.col("ts").alias("timestamp_start_iso"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))).alias("timestamp_end_iso"),
        k.alias("num_texts_processed"),
        (k * 100).alias("total_chars_processed"),
        (F.col("value") * 3).alias("ram_usage_start_mb"),
        F.when(F.col("event_id") % 17 != 0, F.col("value") * 13).alias("ram_usage_end_mb"),
    )


def performance_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance records: one per (user as model, event type as device)."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "value", _k().alias("k"))
    return ev.groupBy("user_id", "event_type").agg(
        F.sum("k").alias("num_sentences_processed"), (F.max("value") / 7).alias("inference_time_s"),
        (F.min("value") * 3).alias("ram_before_load_mb"), (F.max("value") * 13).alias("ram_after_load_mb"),
    ).withColumnsRenamed({"user_id": "model_name", "event_type": "device"})


DEVICE_BY_LANG = {"en": "gpu", "fr": "gpu", "de": "cpu-m1-pro", "es": "cpu-intel"}
DATASET_BY_LANG = {"de": "balanced-de", "en": "balanced-en", "fr": "balanced", "es": "unbalanced"}
#: The CPU devices among them, sorted like the columns of the comparison.
CPU_DEVICES = sorted(d for d in DEVICE_BY_LANG.values() if d.startswith("cpu"))


def _case(c, mapping: dict, default=None):
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance records: one per (source as model, lang as device/timestamp)."""
    d = table(spark, sf_dir, "documents")
    g = d.groupBy("source", "lang").agg(
        F.avg("n_chars").alias("sentences_per_second"),
        F.count(F.lit(1)).alias("output_embedding_dim"),
        (F.max("n_chars") / 10.0).alias("mem"),
    )
    device = _case(F.col("lang"), DEVICE_BY_LANG)
    return g.select(
        F.col("source").alias("model_name"),
        device.alias("device"),
        F.col("lang").alias("timestamp"),
        "sentences_per_second",
        "output_embedding_dim",
        F.when(device == "gpu", F.col("mem")).alias("gpu_memory_allocated_mb"),
    )


def acc_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification runs: one per (source as model, lang as dataset kind).

    Which result files exist is derived from the counts: training metrics are
    missing when the document count is a multiple of 3, the model's own record
    when it is a multiple of 5, the evaluation when no document is labelled, the
    best epoch when the labelled count is 1.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    g = j.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count("quality").alias("n_labelled"),
        F.avg(F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0)).alias("train_acc"),
        F.avg("toxic").alias("val_acc"),
        F.avg("quality").alias("test_acc"),
    )
    return g.select(
        F.col("source").alias("model_name"),
        _case(F.col("lang"), DATASET_BY_LANG).alias("dataset"),
        F.lit(64).cast("bigint").alias("embedding_dimension"),
        F.when(F.col("n_labelled") != 1, F.col("n_labelled") % 7).cast("bigint").alias("epoch"),
        (F.col("n_docs") % 5 != 0).alias("has_model_info"),
        (F.col("n_docs") % 3 != 0).alias("has_training_metrics"),
        (F.col("n_labelled") > 0).alias("has_evaluation"),
        "train_acc", "val_acc", "test_acc",
    )
