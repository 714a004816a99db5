"""Model comparison report (D9: J4, J5, A18, A19, F10, K8, K9).

Two fact tables, one row per result file:

* performance: ``model_name, device, timestamp, sentences_per_second,
  output_embedding_dim, gpu_memory_allocated_mb``;
* classification runs: ``model_name, dataset, embedding_dimension, epoch,
  has_model_info, has_training_metrics, has_evaluation, train_acc, val_acc,
  test_acc`` (``read_runs`` builds it from three files per model).

Each is reduced per model by one hash aggregate with conditional columns
(the pivot values are fixed, so no pass discovers them), then the two are
full-outer-joined on the model name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.functions.text import fixed_decimals, model_path_name
from labelforge.sources.files import read_json_tree, write_json

MODEL = "Model Name"
ACC_KINDS = [("balanced-de", "de", ""), ("balanced-en", "en", ""), ("balanced", "de/en", ""),
             ("unbalanced", "de/en", " (unbalanced)")]
MEMORY = "Memory Usage (MB)"
DIMENSION = "Embedding Dimension"
GPU_SPEED = "Encoding Speed (Sentences/Sec) GPU"


def acc_column(stem: str, metric: str, suffix: str) -> str:
    return f"{stem} - {metric} acc{suffix}"


def comparison_columns(cpu_devices: list[str]) -> list[str]:
    main = [MODEL]
    for metric in ("trainings", "val", "test"):
        for kind, stem, suffix in ACC_KINDS[:3]:
            main.append(acc_column(stem, metric, suffix))
    main += [MEMORY, DIMENSION, GPU_SPEED]
    main += [acc_column("de/en", m, " (unbalanced)") for m in ("trainings", "val", "test")]
    main += [f"Encoding Speed (Sentences/Sec) {d}" for d in cpu_devices]
    return main


def write_runs(runs: DataFrame, root: str) -> None:
    """Result files of the runs, three trees of ``dataset / model`` folders: the
    model's record, its training series and its evaluation, each only for runs
    that have it.  The training series passes through the run's own values at the
    best epoch."""
    runs = runs.withColumns({"d": F.col("dataset"), "m": model_path_name("model_name")})
    write_json(runs.where("has_model_info").select(
        "d", "m", F.col("model_name").alias("embedding_model_name"), "embedding_dimension", "epoch"),
        f"{root}/model_info", ["d", "m"])
    last = F.coalesce("epoch", F.lit(0))

    def series(value: str):
        return F.transform(F.sequence(F.lit(0), last + 2), lambda i: F.col(value) * ((i + 1) / (last + 1))).alias(value)

    write_json(runs.where("has_training_metrics").select("d", "m", series("train_acc"), series("val_acc")),
               f"{root}/training_metrics", ["d", "m"])
    write_json(runs.where("has_evaluation").select("d", "m", F.col("test_acc").alias("accuracy")),
               f"{root}/evaluation_results", ["d", "m"])


def write_training(spark: SparkSession, root: str, dataset: str, name: str, dim: int, classes: int,
                   rounds: list[tuple], best: tuple) -> None:
    """The model's record and its series (one entry per round) as result files of
    one run; ``rounds`` are the rows of ``network.train_network``, ``best`` one of them."""
    place = {"d": F.lit(dataset), "m": F.translate(F.lit(name), ":", "_")}
    info = {"embedding_model_name": name, "embedding_dimension": dim, "classifier_class": "mlp", "num_classes": classes,
            "epoch": best[0], "val_loss": best[3], "val_acc": best[4], "learning_rate": best[6]}
    row = [tuple(info[f.name] for f in spec.MODEL_INFO_SCHEMA.fields)]
    write_json(spark.createDataFrame(row, spec.MODEL_INFO_SCHEMA).withColumns(place), f"{root}/model_info", ["d", "m"])
    series = [tuple([r[i] for r in rounds] for i in (1, 2, 3, 4, 6))]
    write_json(spark.createDataFrame(series, spec.TRAINING_METRICS_SCHEMA).withColumns(place),
               f"{root}/training_metrics", ["d", "m"])


def write_evaluation(summary: DataFrame, root: str, dataset: str, name: str) -> None:
    """The averages of one evaluated run as its result file."""
    write_json(summary.select("accuracy", F.col("macro_f1").alias("macro_avg_f1"),
                              F.col("weighted_f1").alias("weighted_avg_f1"), F.lit(dataset).alias("d"),
                              F.translate(F.lit(name), ":", "_").alias("m")), f"{root}/evaluation_results", ["d", "m"])


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs below ``root``: the three files of a (dataset, model) folder are
    joined, the accuracies looked up at the model's best epoch (null out of range)."""
    def tree(kind: str, schema, flag: str) -> DataFrame:
        files = read_json_tree(spark, f"{root}/{kind}", schema, ["dataset", "folder"], multiline=False, hive_style=True)
        return files.drop("file_name").withColumn(flag, F.lit(True))

    keys = ["dataset", "folder"]
    info = tree("model_info", spec.MODEL_INFO_SCHEMA, "has_model_info") \
        .select(*keys, "embedding_model_name", "embedding_dimension", "epoch", "has_model_info")
    series = tree("training_metrics", spec.TRAINING_METRICS_SCHEMA, "has_training_metrics") \
        .select(*keys, "train_acc", "val_acc", "has_training_metrics")
    tests = tree("evaluation_results", spec.EVALUATION_SCHEMA, "has_evaluation") \
        .select(*keys, F.col("accuracy").alias("test_acc"), "has_evaluation")
    j = info.join(series, keys, "full_outer").join(tests, keys, "full_outer")
    at = F.col("epoch").cast("int")
    flags = ["has_model_info", "has_training_metrics", "has_evaluation"]
    return j.select(F.coalesce("embedding_model_name", "folder").alias("model_name"), "dataset", "embedding_dimension",
                    "epoch", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags],
                    F.get("train_acc", at).alias("train_acc"), F.get("val_acc", at).alias("val_acc"), "test_acc")


def _has_info(runs: DataFrame):
    return F.col("has_model_info") if "has_model_info" in runs.columns else F.lit(True)


def file_checks(runs: DataFrame) -> DataFrame:
    """Add ``reason`` for a run that cannot be used (null when complete)."""
    return runs.withColumn(
        "reason",
        F.when(~_has_info(runs), F.lit("missing model_info.json"))
        .when(~F.col("has_training_metrics"), F.lit("missing training_metrics.json"))
        .when(~F.col("has_evaluation"), F.lit("missing evaluation_results.json"))
        .when(F.col("epoch").isNull(), F.lit("missing epoch")),
    )


def incomplete_runs(runs: DataFrame) -> DataFrame:
    checked = file_checks(runs)
    return checked.where(F.col("reason").isNotNull()).select("model_name", "dataset", "reason")


def cpu_devices(perf: DataFrame) -> list[str]:
    """The CPU device folders that occur, sorted: every device with ``cpu`` in its
    name that isn't a GPU's (one row per device reaches the driver)."""
    name = F.lower("device")
    found = perf.where(name.contains("cpu") & ~name.contains("gpu")).select("device").distinct()
    return sorted(r["device"] for r in found.collect())


def comparison(perf: DataFrame, runs: DataFrame, cpu_devices: list[str]) -> DataFrame:
    """One row per model; performance wins for the dimension, classification
    fills it only when the performance side has none.

    Each side is one aggregate per model: the newest file of a device is a
    ``max_by`` whose ordering is null for other devices, the dataset-kind
    columns are conditional aggregates (no pivot pass, no self-join).
    """
    ts = F.col("timestamp")

    def newest(value: str, device: str):
        mine = F.lower("device").contains("gpu") if device == "gpu" else F.col("device") == device
        return F.max_by(value, F.when(mine, ts))

    p = perf.groupBy("model_name").agg(
        newest("gpu_memory_allocated_mb", "gpu").alias(MEMORY),
        newest("sentences_per_second", "gpu").alias(GPU_SPEED),
        *[newest("sentences_per_second", d).alias(f"Encoding Speed (Sentences/Sec) {d}") for d in cpu_devices],
        F.max_by("output_embedding_dim", F.struct("timestamp", "device")).alias("perf_dim"),
    )

    has_files = _has_info(runs) & F.col("has_training_metrics") & F.col("has_evaluation")
    usable = has_files & F.col("epoch").isNotNull()
    cells = []
    for kind, stem, suffix in ACC_KINDS:
        for metric, src in (("trainings", "train_acc"), ("val", "val_acc"), ("test", "test_acc")):
            cells.append(F.max(F.when(usable & (F.col("dataset") == kind), F.col(src)))
                         .alias(acc_column(stem, metric, suffix)))
    a = runs.groupBy("model_name").agg(
        F.max(F.when(has_files, F.col("embedding_dimension"))).alias("acc_dim"),
        F.max(has_files.cast("int")).alias("_lf_any"),
        *cells,
    ).where(F.col("_lf_any") == 1).drop("_lf_any")

    j = p.join(a, "model_name", "full_outer")
    out = j.withColumn(DIMENSION, F.coalesce(F.col("perf_dim"), F.col("acc_dim"))) \
        .withColumnRenamed("model_name", MODEL).drop("perf_dim", "acc_dim")
    return out.select(*[F.col(f"`{c}`") for c in comparison_columns(cpu_devices)])


def _cell(c: str, dtype: str):
    col = F.col(f"`{c}`")
    if dtype in ("double", "float"):
        text = fixed_decimals(col, 4)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def markdown_rows(table: DataFrame) -> DataFrame:
    """One Markdown table line per row (numbers with 4 decimals, null empty)."""
    types = dict(table.dtypes)
    cells = [_cell(c, types[c]) for c in table.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return table.select(F.col(f"`{MODEL}`").alias("model_name"), line.alias("markdown_row"))


def markdown_header(columns: list[str]) -> str:
    return "| " + " | ".join(columns) + " |\n|" + "|".join(":---" for _ in columns) + "|"
