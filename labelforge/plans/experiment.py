"""End-to-end classification experiment.

train texts -> label encoding (unknown labels rejected) -> stratified
70/30 split on label x language -> batch embedding (written once, read for
training and for the final evaluation) -> class weights -> weighted training in
rounds with early stopping -> best model saved and loaded -> evaluation on
validation and test sets -> result files.

``run_matrix`` (M10) makes one run per configuration line.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.functions.labels import encode_label
from labelforge.operators import embed as emb
from labelforge.operators import evaluate as ev
from labelforge.operators import model as mdl
from labelforge.operators import network
from labelforge.operators import report as rep
from labelforge.operators import sampling as smp
from labelforge.session import scratch_path

SUMMARY_COLS = ["accuracy", "macro_f1", "weighted_f1", "support"]


def run_experiment(spark: SparkSession, train: DataFrame, test: DataFrame, key_col: str,
                   text_col: str = "content", label_col: str = "emotion", prefix_name: str = "none",
                   normalize: bool = True, dim: int = 64, patience: int = spec.PATIENCE,
                   max_rounds: int = 1000, iters_per_round: int = 10, learning_rate: float = 0.01,
                   batch_rows: int = 4096, result_dir: str | None = None,
                   name: str = "hashing", dataset: str = "balanced") -> DataFrame:
    """Summary rows of the validation and the test set.

    The best model is saved below ``result_dir`` (a scratch folder if unset) and
    loaded back for the evaluation; its record, the training series and the
    test evaluation are written there as result files (``report.read_runs``).
    """
    root = result_dir or scratch_path(spark, "experiment")
    labels = spec.TARGET_LABELS
    k = len(labels)

    def encoded(df: DataFrame) -> DataFrame:
        return df.withColumn("emotion_label", encode_label(label_col, labels)).where(
            F.col("emotion_label").isNotNull())

    split = smp.stratified_split(encoded(train), ["emotion_label", "language"], key_col)
    embedded = emb.embed_texts(split, text_col, "embedding", dim, prefix_name, normalize).checkpoint(eager=True)
    tr = embedded.where(F.col("split") == "train")
    va = embedded.where(F.col("split") == "val")
    weights = ev.class_weights(tr, "emotion_label", k)
    model, rounds = network.train_network(tr, va, "embedding", "emotion_label", weights, k, key_col,
                                          learning_rate=learning_rate, batch_rows=batch_rows, max_rounds=max_rounds,
                                          epochs_per_round=iters_per_round, patience=patience)
    best = min(rounds, key=lambda r: (r[3], r[0]))
    mdl.save_model(model, f"{root}/model")
    model = mdl.load_model(f"{root}/model")
    rep.write_training(spark, root, dataset, name, dim, k, rounds, best)
    te = emb.embed_texts(encoded(test), text_col, "embedding", dim, prefix_name, normalize)
    out = None
    for part_name, part in (("val", va), ("test", te)):
        pred = mdl.predict(model, part, "embedding")
        counts = ev.confusion_counts(pred, "emotion_label", "pred_label")
        report = ev.class_report(ev.confusion_long_from_counts(counts, labels), labels, counts=counts)
        summary = ev.report_summary(report, counts, k=k)
        row = summary.select(F.lit(part_name).alias("dataset"), "accuracy", "macro_f1", "weighted_f1", "support")
        out = row if out is None else out.unionByName(row)
    out = out.checkpoint(eager=True)
    rep.write_evaluation(out.where(F.col("dataset") == "test"), root, dataset, name)
    return out.withColumn("best_epoch", F.lit(best[0]).cast("bigint")) \
        .withColumn("epochs_ran", F.lit(len(rounds)).cast("bigint")) \
        .withColumn("best_val_loss", F.lit(float(best[3])))


def run_matrix(lines: Sequence[str], run: Callable[[str, bool, str], DataFrame]) -> DataFrame:
    """One run per line ``name;normalize;prefix``; the rows of all runs, each with
    its configuration.  Blank lines are skipped."""
    def one(line: str) -> DataFrame:
        name, normalize, prefix = (part.strip() for part in line.split(";"))
        flag = normalize.lower() == "true"
        return run(name, flag, prefix).withColumns({
            "model_name": F.lit(name), "normalize": F.lit(flag), "prefix_function": F.lit(prefix)})
    return reduce(DataFrame.unionByName, [one(line) for line in lines if line.strip()])


def centroid_run(split: DataFrame, text_col: str, label_col: str, labels: Sequence[str], normalize: bool,
                 prefix_name: str, dim: int = 64) -> DataFrame:
    """Embed the texts of a split set, fit class means on its train part and
    evaluate the rest; the vectors are written once and read by both."""
    embedded = emb.embed_texts(split, text_col, "embedding", dim, prefix_name, normalize).drop(text_col) \
        .checkpoint(eager=True)
    cents = mdl.centroids(embedded.where("split = 'train'"), "embedding", label_col)
    pred = mdl.centroid_predict(embedded.where("split = 'val'"), cents, "embedding")
    counts = ev.confusion_counts(pred, label_col, "pred_label")
    report = ev.class_report(ev.confusion_long_from_counts(counts, labels), labels, counts=counts)
    return ev.report_summary(report, counts, k=len(labels)).select(*SUMMARY_COLS)
