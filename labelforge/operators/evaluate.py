"""Model evaluation.

The big input (one row per prediction) is reduced once by a map-side
combined ``groupBy(slice, true, pred)``; everything after that works on the
k*k confusion cells per slice, which is bounded by the taxonomy size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.functions.labels import decode_label
from labelforge.functions.vectors import argmax, log_softmax_at
from labelforge.operators.sampling import shuffle_rank
from labelforge.session import ensure_checkpoint_dir


def _classes(k: int):
    return F.sequence(F.lit(0), F.lit(k - 1))


def confusion_counts(df: DataFrame, true_col: str, pred_col: str, slice_cols=()) -> DataFrame:
    """Sparse confusion counts: the only pass over the predictions.

    One map-side combined aggregate; the result (slices x labels^2 rows) is
    written to the checkpoint folder so every report derived from it reads
    this small table instead of the predictions again.
    """
    counts = df.groupBy(*slice_cols, F.col(true_col).alias("true_label"),
                        F.col(pred_col).alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    ensure_checkpoint_dir(df.sparkSession)
    return counts.checkpoint(eager=True)


def confusion_long(df: DataFrame, true_col: str, pred_col: str, labels=spec.TARGET_LABELS,
                   slice_cols=()) -> DataFrame:
    """Dense (true, predicted) grid over the taxonomy; unseen cells are 0.

    Pairs with a label outside the taxonomy are ignored.
    """
    return confusion_long_from_counts(confusion_counts(df, true_col, pred_col, slice_cols), labels, slice_cols)


def confusion_long_from_counts(counts: DataFrame, labels=spec.TARGET_LABELS, slice_cols=()) -> DataFrame:
    k = len(labels)
    slices = counts.select(*slice_cols).distinct() if slice_cols else \
        counts.sparkSession.range(1).select()
    grid = slices.select(*slice_cols, F.explode(_classes(k)).alias("true_label")) \
        .select(*slice_cols, "true_label", F.explode(_classes(k)).alias("pred_label"))
    keys = list(slice_cols) + ["true_label", "pred_label"]
    dense = grid.join(counts, keys, "left").select(
        *keys, F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
    return dense.select(*keys, decode_label("true_label", labels).alias("true_name"),
                        decode_label("pred_label", labels).alias("pred_name"), "n")


def confusion_matrix(long: DataFrame, labels=spec.TARGET_LABELS, slice_cols=()) -> DataFrame:
    """One row per true class, one column per predicted class name."""
    return long.groupBy(*slice_cols, "true_label", "true_name").pivot("pred_name", list(labels)) \
        .agg(F.first("n"))


def class_report(long: DataFrame, labels=spec.TARGET_LABELS, slice_cols=(), counts: DataFrame | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 when a denominator is 0.

    With ``counts`` (all pairs, labels outside the taxonomy included) the margins
    are taken over all rows, and ``long`` only says which classes there are.

    F1 = 2*tp / (support + predicted), which equals 2PR/(P+R).
    """
    pairs = [*slice_cols, "true_label", "pred_label"]
    if counts is not None:
        long = long.select(*pairs, F.lit(0).cast("bigint").alias("n")).unionByName(counts.select(*pairs, "n"))
    cells = long.select(*slice_cols, F.explode(F.array(
        F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
                 .cast("bigint").alias("tp")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )).alias("c")).select(*slice_cols, "c.*")
    per = cells.where(F.col("label").between(0, len(labels) - 1)).groupBy(*slice_cols, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("tp").alias("tp"))
    zero = F.lit(0.0)
    return per.select(
        *slice_cols,
        F.col("label").cast("int").alias("label"),
        decode_label("label", labels).alias("class_name"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), zero).alias("f1"),
        F.col("support").cast("bigint").alias("support"),
        F.col("tp").cast("bigint").alias("tp"),
    )


def report_summary(report: DataFrame, counts: DataFrame, slice_cols=(), k: int = len(spec.TARGET_LABELS)) -> DataFrame:
    """Accuracy, macro and support-weighted averages per slice.

    Accuracy is 0.0 when a true or predicted label lies outside the taxonomy
    (the report then has no accuracy entry); ``outside`` counts such rows.  The per-class rows and the
    confusion counts are stacked and reduced by one conditional aggregate
    per slice (no join).
    """
    inside = F.col("true_label").between(0, k - 1) & F.col("pred_label").between(0, k - 1)
    per_class = report.select(*slice_cols, F.lit(True).alias("_lf_is_class"), "precision", "recall", "f1",
                              F.col("support").cast("double").alias("_lf_sup"), "tp")
    cells = counts.select(*slice_cols, F.lit(False).alias("_lf_is_class"),
                          F.when(inside, 0).otherwise(F.col("n")).alias("_lf_outside"))
    u = per_class.unionByName(cells, allowMissingColumns=True)
    cls = F.col("_lf_is_class")

    def of_classes(c):
        return F.when(cls, c)

    sup = F.sum(of_classes(F.col("_lf_sup")))

    def weighted(c):
        return F.coalesce(F.try_divide(F.sum(of_classes(F.col(c) * F.col("_lf_sup"))), sup), F.lit(0.0))

    outside = F.coalesce(F.sum(F.col("_lf_outside")), F.lit(0))
    tp = F.sum(of_classes(F.col("tp")))
    acc = F.when(outside > 0, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(tp.cast("double"), sup), F.lit(0.0)))
    return u.groupBy(*slice_cols).agg(
        acc.alias("accuracy"),
        F.avg(of_classes(F.col("precision"))).alias("macro_precision"),
        F.avg(of_classes(F.col("recall"))).alias("macro_recall"),
        F.avg(of_classes(F.col("f1"))).alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
        sup.cast("bigint").alias("support"),
        outside.cast("bigint").alias("outside"),
    )


METRICS = [("precision", "precision"), ("recall", "recall"), ("f1-score", "f1")]


def metric_by_class(report: DataFrame, slice_cols=()) -> DataFrame:
    """One metric per class as a series in label order; a metric whose values
    are all below 1e-6 within a slice is left out."""
    long = report.select(*slice_cols, "label", "class_name", F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(col).alias("value")) for name, col in METRICS
    ])).alias("m")).select(*slice_cols, "label", "class_name", "m.metric", "m.value")
    w = Window.partitionBy(*slice_cols, "metric")
    return long.withColumn("_lf_max", F.max("value").over(w)).where(F.col("_lf_max") >= 1e-6).drop("_lf_max")


def report_json(long: DataFrame, report: DataFrame, summary: DataFrame, slice_cols=()) -> DataFrame:
    """The evaluation record as one JSON string per slice: the confusion matrix as
    nested arrays in label order, the report with an entry per class, then
    ``accuracy`` (only when every label is in the taxonomy), ``macro avg`` and
    ``weighted avg``."""
    if not slice_cols:  # one record: a literal slice keeps the joins keyed
        one = [F.lit("all").alias("_lf_slice")]
        out = report_json(long.select("*", *one), report.select("*", *one), summary.select("*", *one),
                          ["_lf_slice"])
        return out.drop("_lf_slice")
    rows = long.groupBy(*slice_cols, "true_label").agg(
        F.array_sort(F.collect_list(F.struct("pred_label", "n"))).alias("r"))
    matrix = rows.groupBy(*slice_cols).agg(
        F.array_sort(F.collect_list(F.struct("true_label", F.transform("r", lambda x: x["n"]).alias("row"))))
        .alias("m")).select(*slice_cols, F.transform("m", lambda x: x["row"]).alias("confusion_matrix"))
    entry = F.struct("precision", "recall", F.col("f1").alias("f1-score"), F.col("support").cast("double").alias("support"))
    in_order = F.array_sort(F.collect_list(F.struct("label", "class_name", entry.alias("entry"))))
    per_class = report.groupBy(*slice_cols).agg(F.map_from_entries(F.transform(
        in_order, lambda c: F.struct(c["class_name"], c["entry"]))).alias("classes"))
    keys = list(slice_cols)
    j = summary.join(matrix, keys).join(per_class, keys)

    def average(kind: str):
        return F.struct(F.struct(*[F.col(f"{kind}_{c}").alias(name) for name, c in METRICS],
                                 F.col("support").cast("double").alias("support")).alias(f"{kind} avg"))

    def inner(value):  # a JSON object without its braces
        text = F.to_json(value)
        return F.substring(text, F.lit(2), F.length(text) - 2)

    total = F.when(F.col("outside") == 0, inner(F.struct("accuracy")))
    whole = F.concat(F.lit("{"), F.concat_ws(",", inner(F.col("classes")), total, inner(average("macro")),
                                             inner(average("weighted"))), F.lit("}"))
    head = inner(F.struct("accuracy", F.col("macro_f1").alias("macro_avg_f1"),
                          F.col("weighted_f1").alias("weighted_avg_f1"), "confusion_matrix"))
    return j.select(*keys, F.concat(F.lit("{"), head, F.lit(',"classification_report":'), whole, F.lit("}"))
                    .alias("evaluation_json"))


# -- A9: class weights --------------------------------------------------------------

def class_weights(df: DataFrame, label_col: str, k: int = len(spec.TARGET_LABELS),
                  alpha: float = spec.CLASS_WEIGHT_ALPHA) -> DataFrame:
    """Balanced weight n / (k * n_c) per class index 0..k-1 and its tempered
    power ``w ** alpha``; a class absent from the data gets null."""
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    classes = df.sparkSession.range(k).select(F.col("id").cast("int").alias("label"))
    j = classes.join(counts, "label", "left")
    total = F.sum("n_c").over(Window.partitionBy())
    w = F.col("_lf_total") / (F.lit(float(k)) * F.col("n_c"))
    return j.withColumn("_lf_total", total).select(
        "label", F.coalesce("n_c", F.lit(0)).cast("bigint").alias("n_c"),
        w.alias("weight"), F.pow(w, F.lit(alpha)).alias("weight_tempered"))


# -- A14 in A13: the loss by batches ---------------------------------------------------

def batched_log_loss(df: DataFrame, logits_col: str, label_col: str, key_col: str, batch_rows: int = spec.BATCH_ROWS,
                     k: int = len(spec.TARGET_LABELS), alpha: float = spec.CLASS_WEIGHT_ALPHA,
                     seed: int = spec.SEED) -> DataFrame:
    """Loss and accuracy as an epoch over batches gives them: the rows in seeded
    order are cut every ``batch_rows``, a batch's loss is its class-weighted mean
    and the epoch's loss the mean over batches weighted by their rows.

    One row: loss, acc, n, batches.  Rows without a label or outside 0..k-1 don't
    count.  Two aggregates: by batch (map-side combined), then over batches."""
    rows = df.where(F.col(label_col).between(0, k - 1)).select(
        key_col, F.col(label_col).cast("int").alias("label"), (-log_softmax_at(logits_col, F.col(label_col))).alias("nll"),
        (argmax(logits_col) == F.col(label_col)).cast("long").alias("right"))
    ranked = shuffle_rank(rows, key_col, seed, "_lf_place")
    w = F.broadcast(class_weights(rows, "label", k, alpha).select("label", F.col("weight_tempered").alias("w")))
    weighted = ranked.join(w, "label")   # one row a class
    per = weighted.groupBy(F.floor(F.col("_lf_place") / batch_rows).alias("batch")).agg(
        F.try_divide(F.sum(F.col("w") * F.col("nll")), F.sum("w")).alias("loss"),
        F.count(F.lit(1)).alias("n"), F.sum("right").alias("right"))
    n = F.sum("n")
    return per.agg(F.try_divide(F.sum(F.col("loss") * F.col("n")), n).alias("loss"),
                   F.try_divide(F.sum("right").cast("double"), n).alias("acc"),
                   F.coalesce(n, F.lit(0)).alias("n"), F.count(F.lit(1)).alias("batches"))


# -- A14: weighted cross-entropy ----------------------------------------------------

def weighted_log_loss(df: DataFrame, logits_col: str, label_col: str, k: int = len(spec.TARGET_LABELS),
                      alpha: float = spec.CLASS_WEIGHT_ALPHA, slice_cols=()) -> DataFrame:
    """``sum(w_y * -log softmax(logits)_y) / sum(w_y)`` per slice, with the
    tempered balanced class weights of the whole input.

    Since w depends only on the class, the loss is
    ``sum_y w_y * S_y / sum_y w_y * n_y`` with S_y, n_y the per-(slice, class)
    sum of -log p_y and row count: one pass over the rows, the weights are
    applied on the small per-class table.
    """
    nll = -log_softmax_at(logits_col, F.col(label_col))
    per = df.groupBy(*slice_cols, F.col(label_col).alias("label")).agg(
        F.sum(nll).alias("_lf_s"), F.count(F.lit(1)).alias("_lf_n"))
    per = per.where(F.col("label").between(0, k - 1))
    by_class = Window.partitionBy("label")
    everything = Window.partitionBy()
    n_c = F.sum("_lf_n").over(by_class)
    total = F.sum("_lf_n").over(everything)
    w = F.pow(total / (F.lit(float(k)) * n_c), F.lit(alpha))
    weighted = per.withColumn("_lf_w", w)
    return weighted.groupBy(*slice_cols).agg(
        (F.sum(F.col("_lf_w") * F.col("_lf_s")) / F.sum(F.col("_lf_w") * F.col("_lf_n"))).alias("weighted_loss"),
        F.sum("_lf_n").alias("n"))
