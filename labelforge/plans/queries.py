"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` each.

Every query reads the driver tables (or data Spark derives from them) in
full.  Floating aggregates are rounded to 9 places so that two engines with
different summation orders agree; ratios of two exact numbers are not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.functions import labels as lab
from labelforge.functions import text as tx
from labelforge.functions import vectors as vec
from labelforge.operators import annotate as ann
from labelforge.operators import embed as emb
from labelforge.operators import evaluate as ev
from labelforge.operators import events as evt
from labelforge.operators import model as mdl
from labelforge.operators import network as net
from labelforge.operators import report as rep
from labelforge.operators import sampling as smp
from labelforge.operators import training as trn
from labelforge.session import materialize, scratch_path
from labelforge.sources import files as fio
from labelforge.sources import views
from labelforge.sources.tables import table

R = 9  # decimals for floating aggregates


def rnd(c, d: int = R):
    return F.round(c if not isinstance(c, str) else F.col(c), d)


def docs(spark, sf):
    return table(spark, sf, "documents")


# ---------------------------------------------------------------------------
# Flagship: class report of a rule-based quality prediction
# ---------------------------------------------------------------------------

QUALITY_LABELS = ["low", "high"]
QUALITY_MIN_CHARS = 1500


def quality_predictions(spark, sf) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "n_chars", "lang")
    lbl = table(spark, sf, "labels").select("doc_id", "quality")
    j = d.join(lbl, "doc_id")
    return j.select("doc_id", "lang", F.col("quality").cast("int").alias("true_label"),
                    F.when(F.col("n_chars") >= QUALITY_MIN_CHARS, 1).otherwise(0).alias("pred_label"))


def q_quality_report(spark, sf):
    p = quality_predictions(spark, sf)
    long = ev.confusion_long(p, "true_label", "pred_label", QUALITY_LABELS)
    r = ev.class_report(long, QUALITY_LABELS)
    return r.select("label", "class_name", rnd("precision").alias("precision"), rnd("recall").alias("recall"),
                    rnd("f1").alias("f1"), "support")


# ---------------------------------------------------------------------------
# Sources, sinks and simple profiling
# ---------------------------------------------------------------------------

def q_csv_roundtrip(spark, sf):
    d = docs(spark, sf)
    path = scratch_path(spark, "csv_roundtrip")
    fio.write_csv(d, path)
    back = fio.read_csv(spark, path, d.schema)
    return back if back is not None else spark.createDataFrame([], d.schema)


HEAD_N = 100


def q_csv_mixed_encoding(spark, sf):
    """Texts of Latin-1 characters in Latin-1 files, the others in UTF-8 files, all in
    one folder; every file is read in the encoding that it has."""
    d = docs(spark, sf)
    latin = F.coalesce(F.col("text").rlike("^[\\x{0}-\\x{FF}]*$"), F.lit(False))
    path = scratch_path(spark, "csv_mixed")
    for narrow, encoding in ((True, "ISO-8859-1"), (False, "UTF-8")):
        part = d.where(latin if narrow else ~latin)
        part.write.mode("append").options(**fio.CSV_OPTIONS).option("encoding", encoding).csv(path)
    back = fio.read_csv_folder(spark, path, d.schema)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", F.length("text").alias("chars"))


def q_head_n(spark, sf):
    return smp.head_n(docs(spark, sf).select("doc_id", "lang", "n_chars"), HEAD_N, "doc_id")


def q_row_ids(spark, sf):
    d = docs(spark, sf).where(F.col("lang") != "en").select("doc_id", "lang")
    return smp.row_ids(d, "doc_id")


def q_value_counts(spark, sf):
    return smp.class_counts(docs(spark, sf), "lang")


def q_counts_by_language(spark, sf):
    return docs(spark, sf).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


def q_language_slice(spark, sf):
    return docs(spark, sf).where(F.col("lang") == "de").select("doc_id", "text", "n_chars")


def q_dataset_valid(spark, sf):
    d = docs(spark, sf)
    return d.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bool_or(F.col("lang") == "en"), F.lit(False)).alias("has_en"),
        F.coalesce(F.bool_or(F.col("lang") == "de"), F.lit(False)).alias("has_de"),
    ).withColumn("valid", (F.col("n_rows") > 0) & F.col("has_en") & F.col("has_de"))


def q_dataset_profile(spark, sf):
    d = docs(spark, sf)
    return d.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.sha2("text", 256)).alias("n_distinct_texts"),
        F.count_distinct("lang").alias("n_languages"),
        F.count_distinct("source").alias("n_sources"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"),
    )


def q_dedup_first(spark, sf):
    return smp.dedup_first(docs(spark, sf), "text", "doc_id")


def q_balance_classes(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang")
    return smp.balance_classes(d, "lang", "doc_id")


def q_shuffle_order(spark, sf):
    return smp.shuffle_rank(docs(spark, sf).select("doc_id"), "doc_id")


def split_frame(spark, sf, with_text: bool = False):
    """Labelled documents split 70/30 on quality x language.

    The split stages its input eagerly, so only the columns the caller needs
    are selected before it (a written stage cannot be pruned afterwards).
    """
    d = docs(spark, sf).select("doc_id", "lang", *([F.sha2("text", 256).alias("text_hash")] if with_text else []))
    lbl = table(spark, sf, "labels").select("doc_id", "quality")
    return smp.stratified_split(d.join(lbl, "doc_id"), ["quality", "lang"], "doc_id")


def q_stratified_split(spark, sf):
    return split_frame(spark, sf).select("doc_id", "stratum", "split")


def q_split_overlap(spark, sf):
    s = materialize(split_frame(spark, sf, with_text=True))  # the text's 32-byte hash
    train = s.where(F.col("split") == "train")
    val = s.where(F.col("split") == "val")
    return smp.overlap(val, train, "text_hash").select("doc_id", "lang")


PREFIX_BY_LANG = {"en": "query", "de": "passage", "fr": "e5_large_instruct", "es": "none"}


def q_prefix_text(spark, sf):
    d = docs(spark, sf)
    name = views._case(F.col("lang"), PREFIX_BY_LANG, "none")
    return d.select("doc_id", tx.prefix_by_name("text", name).alias("prefixed_text"))


def q_text_volume(spark, sf):
    v = evt.text_volume(docs(spark, sf), "text", ["lang"])
    return v.select("lang", "num_texts", "total_chars", rnd("avg_chars_per_text").alias("avg_chars_per_text"))


# ---------------------------------------------------------------------------
# Mail cleaning
# ---------------------------------------------------------------------------

def q_email_clean(spark, sf):
    m = tx.clean_mail(views.raw_mail(spark, sf), "message", "preprocessed_text")
    return tx.drop_empty(m, "preprocessed_text").select("doc_id", "preprocessed_text")


def q_footer_hits(spark, sf):
    m = views.raw_mail(spark, sf)
    sums = m.agg(*[F.sum(tx.footer_hit("message", p).cast("bigint")).alias(f"p{i}")
                   for i, p in enumerate(spec.FOOTER_PATTERNS)])
    entries = F.array(*[F.struct(F.lit(i).alias("pattern_id"), F.lit(p).alias("pattern"),
                                 F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("bigint").alias("n_hits"))
                        for i, p in enumerate(spec.FOOTER_PATTERNS)])
    return sums.select(F.explode(entries).alias("e")).select("e.*")


# ---------------------------------------------------------------------------
# Labels
# ---------------------------------------------------------------------------

def crosswalked(spark, sf):
    p = views.posts(spark, sf)
    return p.withColumn("emotion", lab.crosswalk("sentiment")).dropna(subset=["emotion"]) \
        .withColumn("source", F.lit("crowdflower"))


def q_label_crosswalk(spark, sf):
    return crosswalked(spark, sf).select("doc_id", "sentiment", "emotion", "source")


def q_label_encode(spark, sf):
    p = views.posts(spark, sf).select("doc_id", F.initcap("sentiment").alias("label_name"))
    return p.withColumn("emotion_label", lab.encode_label("label_name"))


def q_fuse_sources(spark, sf):
    a = crosswalked(spark, sf).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item_key"), "text", "emotion", "source")
    b = lab.dominant_label(views.scored_turns(spark, sf), "emotion").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
        .alias("item_key"), "text", "emotion", F.lit("cbet").alias("source"))
    fused = a.unionByName(b, allowMissingColumns=True)
    return fused.where(F.col("emotion").isin(*spec.TARGET_LABELS))


def q_dominant_label(spark, sf):
    s = views.scored_posts(spark, sf)
    return lab.dominant_label(s, "emotion").select("vec_id", "emotion")


def q_class_weights(spark, sf):
    p = table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("true_label"))
    w = ev.class_weights(p, "true_label", len(views.VECTOR_LABELS))
    return w.select("label", "n_c", rnd("weight").alias("weight"), rnd("weight_tempered").alias("weight_tempered"))


# ---------------------------------------------------------------------------
# Annotation, vote, translation
# ---------------------------------------------------------------------------

def annotated(spark, sf, keep_text: bool = False):
    """Annotation results, written once before use (client calls are never
    repeated), without the text unless it is asked for."""
    d = docs(spark, sf).select(F.col("doc_id").alias("email_id"), "text")
    a = ann.annotate(d, "email_id", "text")
    return ann.materialize(a if keep_text else a.drop("text"))


def q_annotate_attempts(spark, sf):
    a = ann.attempts_long(annotated(spark, sf), "email_id")
    return a.select("email_id", "attempt_id", "emotion", "success", "elapsed_time", "raw_response", "error")


def q_annotate_validate(spark, sf):
    a = ann.attempts_long(annotated(spark, sf), "email_id")
    return a.groupBy("emotion", "success", F.col("error").isNotNull().alias("has_error")) \
        .agg(F.count(F.lit(1)).alias("n"))


def q_vote(spark, sf):
    v = ann.vote(annotated(spark, sf), "email_id")
    return v.select("email_id", "emotion", "confidence", "emotion_counts")


def q_vote_wide(spark, sf):
    v = ann.vote(annotated(spark, sf), "email_id")
    return v.select("email_id", *[f"emotion_attempt_{i + 1}" for i in range(spec.NUM_ATTEMPTS)])


def q_annotate_prompt(spark, sf):
    return docs(spark, sf).select("doc_id", tx.annotate_prompt("text").alias("prompt"))


def q_prefix_columns(spark, sf):
    v = ann.vote(annotated(spark, sf, keep_text=True), "email_id")
    classified = v.withColumnRenamed("text", "content").withColumn("language", F.lit("en"))
    label_cols = [c for c in classified.columns if c.startswith("emotion") or c == "confidence"]
    return classified.select("email_id", "content", "language", *label_cols)


def q_translate_status(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    t = ann.translate(d, "doc_id", "text")
    return t.select("doc_id", "translated_text", "success", "raw_response", "error")


def q_combine_languages(spark, sf):
    base = crosswalked(spark, sf).select("doc_id", "text", "emotion", "source")
    t = ann.translate(base, "doc_id", "text")
    both = F.array(F.struct(F.lit("en").alias("language"), F.col("text").alias("content")),
                   F.struct(F.lit("de").alias("language"), F.col("translated_text").alias("content")))
    return t.select("doc_id", "emotion", "source", F.explode(both).alias("r")) \
        .select("doc_id", "r.language", "r.content", "emotion", "source")


# ---------------------------------------------------------------------------
# Evaluation
# ---------------------------------------------------------------------------

def sliced_predictions(spark, sf):
    p = views.predictions(spark, sf)
    return p.withColumn("slice", F.explode(F.array(F.col("language"), F.lit("all"))))


def q_confusion_long(spark, sf):
    return ev.confusion_long(views.predictions(spark, sf), "true_label", "pred_label", views.VECTOR_LABELS)


def q_confusion_matrix(spark, sf):
    long = ev.confusion_long(views.predictions(spark, sf), "true_label", "pred_label", views.VECTOR_LABELS)
    return ev.confusion_matrix(long, views.VECTOR_LABELS)


def _report(spark, sf):
    counts = ev.confusion_counts(sliced_predictions(spark, sf), "true_label", "pred_label", ["slice"])
    long = ev.confusion_long_from_counts(counts, views.VECTOR_LABELS, ["slice"])
    return counts, long, ev.class_report(long, views.VECTOR_LABELS, ["slice"], counts=counts)


def q_class_report(spark, sf):
    _, _, r = _report(spark, sf)
    return r.select("slice", "label", "class_name", rnd("precision").alias("precision"),
                    rnd("recall").alias("recall"), rnd("f1").alias("f1"), "support")


def q_report_summary(spark, sf):
    counts, _, r = _report(spark, sf)
    s = ev.report_summary(r, counts, ["slice"], len(views.VECTOR_LABELS))
    return s.select("slice", *[rnd(c).alias(c) for c in
                               ["accuracy", "macro_precision", "macro_recall", "macro_f1",
                                "weighted_precision", "weighted_recall", "weighted_f1"]], "support")


def q_metric_by_class(spark, sf):
    _, _, r = _report(spark, sf)
    m = ev.metric_by_class(r, ["slice"])
    return m.select("slice", "metric", "label", "class_name", rnd("value").alias("value"))


def q_report_json(spark, sf):
    counts, long, r = _report(spark, sf)
    s = ev.report_summary(r, counts, ["slice"], len(views.VECTOR_LABELS))
    return ev.report_json(long, r, s, ["slice"])


def q_report_json_fields(spark, sf):
    """The evaluation records read back by name."""
    j = q_report_json(spark, sf)

    def number(path: str):
        return F.get_json_object("evaluation_json", path).cast("double")

    rows = F.from_json(F.get_json_object("evaluation_json", "$.confusion_matrix"), "array<array<bigint>>")
    right = F.aggregate(F.transform(rows, lambda r, i: F.get(r, i)), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    report = "$.classification_report"
    return j.select(
        "slice", rnd(number("$.accuracy")).alias("accuracy"), rnd(number(f"{report}.accuracy")).alias("report_accuracy"),
        *[rnd(number(f"{report}['{kind} avg']['{name}']")).alias(f"{kind}_{c}")
          for kind in ("macro", "weighted") for name, c in ev.METRICS],
        *[rnd(number(f"{report}['{label}'].recall")).alias(f"recall_{label}") for label in views.VECTOR_LABELS],
        number(f"{report}['weighted avg'].support").cast("bigint").alias("support"), right.alias("n_right"))


def q_argmax_predict(spark, sf):
    e = table(spark, sf, "embeddings")
    p = mdl.centroid_predict(e, mdl.centroids(e, "embedding", "label"), "embedding")
    return p.select("vec_id", vec.argmax("embedding").alias("argmax_all"), "pred_label")


def q_weighted_log_loss(spark, sf):
    e = table(spark, sf, "embeddings")
    scored = mdl.centroid_scores(e, mdl.centroids(e, "embedding", "label"), "embedding", "logits")
    p = scored.select("logits", F.col("label").alias("y"),
                      F.when(F.col("vec_id") % 2 == 0, "en").otherwise("de").alias("language"))
    out = ev.weighted_log_loss(p, "logits", "y", len(views.VECTOR_LABELS), slice_cols=["language"])
    return out.select("language", rnd("weighted_loss").alias("weighted_loss"), "n")


def q_l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select("vec_id", vec.l2_norm("embedding").alias("norm"),
                 vec.l2_normalize("embedding").alias("unit"))
    return n.select("vec_id", rnd("norm").alias("norm"),
                    rnd(F.get("unit", 0)).alias("first_component"),
                    rnd(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x)).alias("component_sum"),
                    rnd(F.array_max("unit")).alias("max_component"),
                    rnd(vec.l2_norm("unit")).alias("unit_norm"))


# ---------------------------------------------------------------------------
# Models and embeddings (rows-only checks)
# ---------------------------------------------------------------------------

def embedding_split(spark, sf):
    """Split once, written before its train and validation parts are read."""
    e = table(spark, sf, "embeddings")
    return materialize(smp.stratified_split(e, ["label"], "vec_id"))


def q_train_classifier(spark, sf):
    k = len(views.VECTOR_LABELS)
    s = embedding_split(spark, sf).withColumn("y", F.col("label").cast("int"))
    train, val = s.where(F.col("split") == "train"), s.where(F.col("split") == "val")
    w = ev.class_weights(train, "y", k)
    _, rows = net.train_network(train, val, "embedding", "y", w, k, "vec_id", learning_rate=0.01, epochs_per_round=5,
                                patience=spec.PATIENCE)
    return spark.createDataFrame(rows, mdl.METRICS_SCHEMA)


def fixed_network(spark):
    """A network 64 -> 8 -> 10 whose weights are a rule of their places."""
    def layer(i: int, inputs: int, width: int):
        block = min(inputs, 16)
        cell = lambda r, c: ((r * 7 + c * 13 + i * 5) % 11 - 5) / F.lit(10.0)
        blocks = spark.range(inputs // block).select(F.lit(i).alias("layer"), F.col("id").cast("int").alias("block"),
                                                     (F.col("id") * block).cast("int").alias("first"))
        at = F.sequence(F.lit(0), F.lit(block * width - 1))
        weights = F.transform(at, lambda p: cell(F.col("first") + F.floor(p / width).cast("int"), p % width))
        bias = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: (c % 3 - 1) / F.lit(4.0))
        return blocks.select("*", F.lit(width).alias("width"), weights.alias("weights"),
                             F.when(F.col("block") == 0, bias).alias("bias"))
    return layer(0, 64, 8).unionByName(layer(1, 8, 10))


def q_mlp_forward(spark, sf):
    """Forward pass with given weights, the matrices joined in blocks."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = net.apply_network(e, fixed_network(spark), "embedding", "logits", max_shipped=0)
    return out.select("vec_id", *[rnd(F.get("logits", i)).alias(f"logit_{i}") for i in range(10)],
                      vec.argmax(F.transform("logits", lambda x: rnd(x))).alias("pred_label"))


def q_batched_loss(spark, sf):
    """Loss over seeded batches of the first ten vector entries taken as logits."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", vec.elements("embedding", 1, 10).alias("logits"))
    out = ev.batched_log_loss(e, "logits", "label", "vec_id", k=len(views.VECTOR_LABELS))
    return out.select(rnd("loss").alias("loss"), rnd("acc").alias("acc"), "n", "batches")


def q_centroid_eval(spark, sf):
    s = embedding_split(spark, sf)
    train = s.where(F.col("split") == "train")
    val = s.where(F.col("split") == "val")
    cents = mdl.centroids(train, "embedding", "label")
    pred = mdl.centroid_predict(val, cents, "embedding")
    names = views.VECTOR_LABELS
    counts = ev.confusion_counts(pred, "label", "pred_label")
    r = ev.class_report(ev.confusion_long_from_counts(counts, names), names)
    s = ev.report_summary(r, counts, k=len(names))
    return s.select(*[rnd(c).alias(c) for c in ["accuracy", "macro_precision", "macro_recall", "macro_f1",
                                                 "weighted_precision", "weighted_recall", "weighted_f1"]],
                    "support")


def q_embed_texts(spark, sf):
    """Token counts per bucket: every component enters the two checksums."""
    d = docs(spark, sf).select("doc_id", "text")
    e = emb.embed_texts(d, "text", "embedding", dim=64, prefix_name="query", normalize=False)
    placed = F.zip_with("embedding", F.sequence(F.lit(1), F.size("embedding")), lambda x, i: x.cast("double") * i)
    return e.select("doc_id", F.size("embedding").alias("dim"), rnd(vec.l2_norm("embedding")).alias("norm"),
                    F.get("embedding", F.lit(0)).cast("double").alias("first"),
                    F.aggregate(placed, F.lit(0.0), lambda acc, x: acc + x).alias("placed_sum"),
                    vec.argmax("embedding").alias("largest"))


def q_run_matrix(spark, sf):
    """One run per configuration: quality of the labelled documents by class means."""
    from labelforge.plans.experiment import centroid_run, run_matrix
    known = table(spark, sf, "labels").where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    d = docs(spark, sf).select("doc_id", "text")
    parts = smp.stratified_split(d.select("doc_id").join(known, "doc_id"), ["label"], "doc_id")  # ids only
    split = materialize(d.join(parts.select("doc_id", "label", "split"), "doc_id"))
    out = run_matrix(spec.RUN_CONFIGS, lambda name, normalize, prefix: centroid_run(
        split, "text", "label", ["low", "high"], normalize, prefix))
    return out.select("model_name", "normalize", "prefix_function",
                      *[rnd(c).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")], "support")


def q_encode_throughput(spark, sf):
    return emb.encode_throughput(spark, docs(spark, sf), "text", "hashing-64", dim=64)


def q_encode_counts(spark, sf):
    """What the throughput job counts while it encodes: all but its timings."""
    return emb.encode_throughput(spark, docs(spark, sf), "text", "hashing-32", dim=32, prefix_name="query").select(
        "model_name", "prefix_function_name", "num_sentences_processed", "num_failed", "output_embedding_dim", "error")


def q_performance_facts(spark, sf):
    """Throughput and memory footprint of the performance records."""
    out = evt.performance_facts(views.performance_records(spark, sf))
    return out.select("model_name", "device", "num_sentences_processed", "sentences_per_second", "model_ram_footprint_mb")


# ---------------------------------------------------------------------------
# Monitoring events
# ---------------------------------------------------------------------------

def derived_events(spark, sf):
    return evt.event_metrics(evt.event_basics(views.runs(spark, sf)))


def q_event_metrics(spark, sf):
    e = derived_events(spark, sf).where(F.col("event_type") == "inference_run")
    return e.select("event_id", "avg_chars_per_text", "seconds_per_text", "seconds_per_1k_chars")


def q_event_roundtrip(spark, sf):
    e = derived_events(spark, sf)
    path = scratch_path(spark, "events_json")
    fio.write_json(e.withColumn("event_id", F.col("event_id").cast("string")), path)
    valid, _ = fio.read_event_lists(spark, path, spec.EVENT_SCHEMA, event_type="inference_run", multiline=False)
    return valid.select(F.col("event_id").cast("bigint").alias("event_id"), "context_name", "duration_seconds",
                        "num_texts_processed", "seconds_per_text")


def q_event_arrays(spark, sf):
    """Event files with one array each, at most 500 events; every 50th event holds a
    count that isn't a number and is set aside alone."""
    e = derived_events(spark, sf).withColumn("event_id", F.col("event_id").cast("string"))
    broken = F.col("event_id").cast("bigint") % 50 == 0
    text = F.struct(*[F.when(broken, F.lit("many")).otherwise(F.col(c).cast("string")).alias(c)
                      if c == "num_texts_processed" else c for c in e.columns])
    block = F.floor(F.col("event_id").cast("bigint") / 500)
    arrays = e.groupBy(block.alias("block")).agg(F.to_json(F.collect_list(text)).alias("value"))
    path = scratch_path(spark, "event_arrays")
    arrays.write.partitionBy("block").option("lineSep", "\n").text(path)
    valid, _ = fio.read_event_arrays(spark, path, spec.EVENT_SCHEMA, glob="*.txt")
    return valid.select(F.col("event_id").cast("bigint").alias("event_id"), "context_name", "duration_seconds",
                        "num_texts_processed", "seconds_per_text")


def q_event_sink(spark, sf):
    """Events written in a folder a context, those of even contexts once more: a rerun
    replaces its own contexts only."""
    e = derived_events(spark, sf).withColumn("event_id", F.col("event_id").cast("string"))
    path = scratch_path(spark, "event_sink")
    fio.write_events(e, path)
    fio.write_events(e.where(F.crc32(F.col("context_name").cast("binary")) % 2 == 0), path)
    valid, _ = fio.read_event_lists(spark, path, spec.EVENT_SCHEMA, event_type=None, multiline=False)
    return valid.select(F.col("event_id").cast("bigint").alias("event_id"), "context_name", "event_type")


def q_event_times(spark, sf):
    """Start/end stamps in ISO format and the elapsed seconds between them."""
    r = evt.event_basics(views.runs(spark, sf))
    start, end = F.col("timestamp_start_iso"), F.col("timestamp_end_iso")
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return r.select("event_id", F.date_format(start, iso).alias("start_iso"), F.date_format(end, iso).alias("end_iso"),
                    F.col("duration_seconds").alias("elapsed_seconds"),
                    tx.event_file_name("context_name", end).alias("file_name"))


def q_pc_compat(spark, sf):
    return evt.pc_compatibility(derived_events(spark, sf))


# ---------------------------------------------------------------------------
# Training curves
# ---------------------------------------------------------------------------

def q_epoch_metrics(spark, sf):
    e = views.epochs(spark, sf).withColumn("epoch_group", F.floor(F.col("epoch") / 10).cast("bigint"))
    m = trn.batch_weighted_metrics(e, ["run_id", "epoch_group"], "val_loss", "val_acc", "n_samples")
    return m.select("run_id", "epoch_group", rnd("loss").alias("loss"), rnd("acc").alias("acc"), "n_samples")


def ran(spark, sf):
    return trn.ran_epochs(views.epochs(spark, sf))


def q_no_improve(spark, sf):
    f = trn.no_improvement(views.epochs(spark, sf))
    return f.select("run_id", "epoch", "improved", "no_improve")


def q_early_stop(spark, sf):
    f = trn.no_improvement(views.epochs(spark, sf))
    return trn.early_stop_epochs(f)


def q_best_epoch(spark, sf):
    return trn.best_epoch(ran(spark, sf))


def q_run_summary(spark, sf):
    return trn.run_summary(ran(spark, sf))


def q_epoch_lookup(spark, sf):
    series = materialize(views.epochs(spark, sf))
    summary = trn.run_summary(trn.ran_epochs(series))
    points = summary.select("run_id", F.explode(F.array(
        F.struct(F.lit("best").alias("point"), F.col("best_epoch").alias("epoch")),
        F.struct(F.lit("past_end").alias("point"), (F.col("best_epoch") + 100000).alias("epoch")),
    )).alias("p")).select("run_id", "p.point", "p.epoch")
    return trn.epoch_lookup(points, series, ["train_acc", "val_acc"])


# ---------------------------------------------------------------------------
# Comparison report, names, configuration
# ---------------------------------------------------------------------------

def stored_runs(spark, sf):
    """The runs written as result files and read back from them."""
    root = scratch_path(spark, "result_files")
    rep.write_runs(materialize(views.acc_runs(spark, sf)), root)
    return rep.read_runs(spark, root)


def comparison_table(spark, sf):
    perf = views.perf(spark, sf)
    return rep.comparison(perf, stored_runs(spark, sf), rep.cpu_devices(perf))


def q_model_comparison(spark, sf):
    t = comparison_table(spark, sf)
    types = dict(t.dtypes)
    return t.select(*[rnd(F.col(f"`{c}`")).alias(c) if types[c] == "double" else F.col(f"`{c}`")
                      for c in t.columns])


def q_incomplete_models(spark, sf):
    return rep.incomplete_runs(stored_runs(spark, sf))


def q_markdown_rows(spark, sf):
    return rep.markdown_rows(comparison_table(spark, sf))


PERF_TREE_LEVELS = ["device_folder", "timestamp_folder", "model_folder"]


def q_result_tree(spark, sf):
    """Performance records written as a folder tree (device / timestamp /
    model, one JSON file per leaf) and scanned back with the levels parsed
    from the paths."""
    perf = views.perf(spark, sf)
    root = scratch_path(spark, "perf_tree")
    fio.write_json(perf.withColumnRenamed("device", "d").withColumnRenamed("timestamp", "t")
                   .withColumn("m", tx.model_path_name("model_name")), root, partition_by=["d", "t", "m"])
    back = fio.read_json_tree(spark, root, spec.PERFORMANCE_SCHEMA, PERF_TREE_LEVELS, glob="*.json",
                              multiline=False, hive_style=True)
    return back.select("model_name", F.col("device_folder").alias("device"),
                       F.col("timestamp_folder").alias("timestamp"), "sentences_per_second",
                       "output_embedding_dim")


def q_leaf_records(spark, sf):
    """A result tree whose leaves hold two files each, the second with the dimension's
    sign changed: a leaf gives one record, that of its first file by name."""
    perf = views.perf(spark, sf).withColumnRenamed("device", "d").withColumnRenamed("timestamp", "t") \
        .withColumn("m", tx.model_path_name("model_name"))
    root = scratch_path(spark, "perf_leaves")
    levels = ["d", "t", "m"]
    first = perf.select(*levels, F.to_json(F.struct("model_name", "sentences_per_second", "output_embedding_dim")).alias("value"))
    second = perf.select(*levels, F.to_json(F.struct("model_name", (-F.col("output_embedding_dim")).alias("output_embedding_dim")))
                         .alias("value"))
    first.write.partitionBy(*levels).option("compression", "none").text(root)
    second.write.mode("append").partitionBy(*levels).option("compression", "gzip").text(root)
    back = fio.read_json_tree(spark, root, spec.PERFORMANCE_SCHEMA, PERF_TREE_LEVELS, glob="*.txt*", multiline=False,
                              hive_style=True, one_per_leaf=True)
    return back.groupBy("model_name", F.col("device_folder").alias("device")).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("timestamp_folder").alias("leaves"),
        F.sum(F.abs("output_embedding_dim")).alias("dimensions"))


def q_result_paths(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+(/[^?#]*)?", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return p.select(
        "page_id",
        F.regexp_extract("url", r"^([A-Za-z]+)://", 1).alias("scheme"),
        F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1).alias("host"),
        path.alias("path"),
        F.get(parts, 0).alias("level_1"),
        F.get(parts, 1).alias("level_2"),
        F.size(parts).cast("bigint").alias("n_levels"),
        F.regexp_extract("url", r"\?([^#]*)", 1).alias("query"),
    )


def q_safe_names(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    safe = tx.safe_name("url")
    return p.select("page_id", safe.alias("safe_name"), tx.model_path_name("url").alias("model_path"),
                    F.concat(F.lit("monitoring_events_"), safe, F.lit(".json")).alias("file_name"))


def q_config_parse(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    names = F.array(*[F.lit(n) for n in spec.PREFIX_NAMES])
    host = F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1)
    line = F.concat_ws(";", host, F.when(F.col("page_id") % 2 == 0, "true").otherwise("false"),
                       F.get(names, (F.col("page_id") % 4).cast("int")))
    parts = F.split(line, ";")
    return p.select("page_id", F.get(parts, 0).alias("model_name"),
                    (F.lower(F.get(parts, 1)) == "true").alias("normalize"),
                    F.get(parts, 2).alias("prefix_function"))


def q_post_dataset(spark, sf):
    from labelforge.plans.datasets import post_dataset
    return post_dataset(spark, sf)


def q_mail_dataset(spark, sf):
    from labelforge.plans.datasets import mail_dataset
    return mail_dataset(spark, sf)


def q_experiment(spark, sf):
    """Train on the labelled mails, test on the labelled posts."""
    from labelforge.plans.datasets import mail_dataset, post_dataset
    from labelforge.plans.experiment import run_experiment
    train = mail_dataset(spark, sf).withColumn("key", F.concat_ws("_", "email_id", "language"))
    test = post_dataset(spark, sf)
    return run_experiment(spark, train, test, "key")


def q_stage_reuse(spark, sf):
    """A stage asked for again and again: whether it was built, and its rows.  It is built at
    first, after a write that never ended (no manifest), after its input grew and
    for other settings; else it is read back."""
    source, path = scratch_path(spark, "stage_input"), scratch_path(spark, "stage")
    rows = docs(spark, sf).select("doc_id", "lang")
    rows.write.parquet(source)
    built = []

    def build():
        built.append(True)
        return spark.read.parquet(source).where(F.col("lang").isNotNull())

    def ask(step, **settings):
        before = len(built)
        out = fio.ensure_stage(spark, path, build, ["doc_id", "lang"], F.col("lang") == "en", [source], settings)
        return step, len(built) > before, out.count()

    seen = [ask("first"), ask("again")]
    rows.where(F.col("lang") == "en").write.mode("overwrite").parquet(path)
    seen.append(ask("half written"))
    rows.write.mode("append").parquet(source)
    seen += [ask("input grown"), ask("input as before"), ask("other settings", version=2)]
    return spark.createDataFrame(seen, "step string, built boolean, n_rows long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "quality_report": q_quality_report,
    "csv_roundtrip": q_csv_roundtrip,
    "head_n": q_head_n,
    "row_ids": q_row_ids,
    "value_counts": q_value_counts,
    "counts_by_language": q_counts_by_language,
    "language_slice": q_language_slice,
    "dataset_valid": q_dataset_valid,
    "dataset_profile": q_dataset_profile,
    "dedup_first": q_dedup_first,
    "balance_classes": q_balance_classes,
    "shuffle_order": q_shuffle_order,
    "stratified_split": q_stratified_split,
    "split_overlap": q_split_overlap,
    "prefix_text": q_prefix_text,
    "text_volume": q_text_volume,
    "email_clean": q_email_clean,
    "footer_hits": q_footer_hits,
    "label_crosswalk": q_label_crosswalk,
    "label_encode": q_label_encode,
    "fuse_sources": q_fuse_sources,
    "dominant_label": q_dominant_label,
    "class_weights": q_class_weights,
    "annotate_attempts": q_annotate_attempts,
    "annotate_validate": q_annotate_validate,
    "vote": q_vote,
    "vote_wide": q_vote_wide,
    "annotate_prompt": q_annotate_prompt,
    "prefix_columns": q_prefix_columns,
    "translate_status": q_translate_status,
    "combine_languages": q_combine_languages,
    "confusion_long": q_confusion_long,
    "confusion_matrix": q_confusion_matrix,
    "class_report": q_class_report,
    "report_summary": q_report_summary,
    "metric_by_class": q_metric_by_class,
    "report_json": q_report_json,
    "report_json_fields": q_report_json_fields,
    "argmax_predict": q_argmax_predict,
    "weighted_log_loss": q_weighted_log_loss,
    "l2_normalize": q_l2_normalize,
    "train_classifier": q_train_classifier,
    "mlp_forward": q_mlp_forward,
    "batched_loss": q_batched_loss,
    "csv_mixed_encoding": q_csv_mixed_encoding,
    "event_arrays": q_event_arrays,
    "event_sink": q_event_sink,
    "leaf_records": q_leaf_records,
    "centroid_eval": q_centroid_eval,
    "embed_texts": q_embed_texts,
    "run_matrix": q_run_matrix,
    "encode_throughput": q_encode_throughput,
    "encode_counts": q_encode_counts,
    "performance_facts": q_performance_facts,
    "event_metrics": q_event_metrics,
    "event_roundtrip": q_event_roundtrip,
    "pc_compat": q_pc_compat,
    "epoch_metrics": q_epoch_metrics,
    "no_improve": q_no_improve,
    "early_stop": q_early_stop,
    "best_epoch": q_best_epoch,
    "run_summary": q_run_summary,
    "epoch_lookup": q_epoch_lookup,
    "model_comparison": q_model_comparison,
    "incomplete_models": q_incomplete_models,
    "markdown_rows": q_markdown_rows,
    "result_paths": q_result_paths,
    "safe_names": q_safe_names,
    "config_parse": q_config_parse,
    "event_times": q_event_times,
    "result_tree": q_result_tree,
    "post_dataset": q_post_dataset,
    "mail_dataset": q_mail_dataset,
    "experiment": q_experiment,
    "stage_reuse": q_stage_reuse,
}
