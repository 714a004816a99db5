"""Sources, sinks, stages, streaming and the driver contract."""

import json
import os
import tempfile

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF
from labelforge import spec
from labelforge.operators import report as rep
from labelforge.sources import files as fio
from labelforge.sources import views


def test_csv_roundtrip_special_characters(spark):
    rows = [(1, 'quote " inside'), (2, "back\\slash"), (3, "multi\nline\r\ntext"), (4, "comma, and ;")]
    df = spark.createDataFrame(rows, "id long, t string")
    path = tempfile.mkdtemp(prefix="lf-csv-") + "/out"
    fio.write_csv(df, path)
    back = fio.read_csv(spark, path, df.schema)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_csv_missing_or_empty_is_none(spark):
    schema = T.StructType([T.StructField("a", T.StringType())])
    assert fio.read_csv(spark, "/nonexistent/lf/path", schema) is None
    path = tempfile.mkdtemp(prefix="lf-csv-") + "/empty"
    assert fio.write_csv(spark.createDataFrame([], schema), path, skip_empty=True) is False
    assert not os.path.exists(path)


def test_ensure_stage_reuses(spark):
    path = tempfile.mkdtemp(prefix="lf-stage-") + "/stage"
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", "en")], "text string, language string")

    pred = F.col("language") == "en"
    fio.ensure_stage(spark, path, build, ["text", "language"], pred)
    out = fio.ensure_stage(spark, path, build, ["text", "language"], pred)
    assert len(calls) == 1 and out.count() == 1
    fio.ensure_stage(spark, path, build, ["text", "missing_col"])
    assert len(calls) == 2


def test_json_tree_levels(spark):
    root = tempfile.mkdtemp(prefix="lf-tree-")
    recs = [("gpu", "20250511_1", "fam", "m1", {"model_name": "fam/m1", "sentences_per_second": 5.0}),
            ("cpu-x", "20250511_2", "fam", "m2", {"model_name": "fam/m2", "sentences_per_second": 2.5})]
    for dev, ts, fam, model, rec in recs:
        d = os.path.join(root, dev, ts, fam, model)
        os.makedirs(d)
        with open(os.path.join(d, "benchmark.json"), "w") as f:
            json.dump(rec, f, indent=2)
    df = fio.read_json_tree(spark, root, spec.PERFORMANCE_SCHEMA, ["device_folder", "ts_folder", "family", "model"])
    got = sorted((r["device_folder"], r["ts_folder"], r["model"], r["sentences_per_second"]) for r in df.collect())
    assert got == [("cpu-x", "20250511_2", "m2", 2.5), ("gpu", "20250511_1", "m1", 5.0)]


def test_event_list_file(spark):
    d = tempfile.mkdtemp(prefix="lf-ev-")
    times = {"timestamp_start_iso": "2025-05-11T10:00:00", "timestamp_end_iso": "2025-05-11T10:00:02"}
    events = [
        {"event_id": "a", "context_name": "c", "event_type": "model_load", "duration_seconds": 1.0, **times},
        {"event_id": "b", "context_name": "c", "event_type": "inference_run", "duration_seconds": 2.0,
         "num_texts_processed": 4, "seconds_per_text": 0.5, **times},
        {"event_id": "c", "context_name": "c", "event_type": "inference_run"},
    ]
    with open(os.path.join(d, "monitoring_events_c.json"), "w") as f:
        json.dump(events, f, indent=4)
    valid, rejected = fio.read_event_lists(spark, d, spec.EVENT_SCHEMA)
    assert [r["event_id"] for r in valid.collect()] == ["b"]
    assert rejected.count() == 1


def test_event_list_verdict_does_not_depend_on_columns(spark):
    d = tempfile.mkdtemp(prefix="lf-ev-")
    good = {"event_id": "a", "context_name": "c", "event_type": "inference_run", "duration_seconds": 1.0,
            "timestamp_start_iso": "2025-05-11T10:00:00", "timestamp_end_iso": "2025-05-11T10:00:02"}
    bad = [{**good, "num_texts_processed": "many"}, {**good, "timestamp_end_iso": "soon"}]
    bad += [{k: v for k, v in good.items() if k != name} for name in spec.EVENT_REQUIRED]
    with open(os.path.join(d, "e.json"), "w") as f:
        f.write("\n".join(json.dumps(x) for x in [good, *bad]) + "\n{broken\n")
    valid, rejected = fio.read_event_lists(spark, d, spec.EVENT_SCHEMA, event_type=None, multiline=False)
    assert valid.count() == len(valid.collect()) == len(valid.select("event_id").collect()) == 1
    assert rejected.count() == len(rejected.collect()) == len(bad) + 1


def test_runs_from_result_files(spark):
    rows = [("m:a", "balanced", 64, 1, True, True, True, 0.5, 0.25, 0.75),
            ("m:b", "balanced", 64, None, True, True, True, 0.5, 0.25, 0.75),
            ("m:c", "balanced", 64, 0, False, True, True, 0.5, 0.25, 0.75),
            ("m:d", "balanced", 64, 0, True, False, False, 0.5, 0.25, 0.75)]
    runs = spark.createDataFrame(rows, "model_name string, dataset string, embedding_dimension long, epoch long, "
                                 "has_model_info boolean, has_training_metrics boolean, has_evaluation boolean, "
                                 "train_acc double, val_acc double, test_acc double")
    root = tempfile.mkdtemp(prefix="lf-runs-")
    rep.write_runs(runs, root)
    back = rep.read_runs(spark, root)
    got = {r["model_name"]: r for r in back.collect()}
    assert sorted(got) == ["m:a", "m:b", "m:d", "m_c"]  # without its record a model has its folder's name
    assert (got["m:a"]["train_acc"], got["m:a"]["val_acc"], got["m:a"]["test_acc"]) == (0.5, 0.25, 0.75)
    assert got["m:b"]["train_acc"] is None
    assert {r["model_name"]: r["reason"] for r in rep.incomplete_runs(back).collect()} == {
        "m:b": "missing epoch", "m_c": "missing model_info.json", "m:d": "missing training_metrics.json"}


def test_experiment_leaves_a_model_and_result_files(spark):
    from labelforge.functions.labels import encode_label
    from labelforge.operators import embed as emb
    from labelforge.operators import model as mdl
    from labelforge.plans.experiment import run_experiment
    rows = [(f"k{i}", f"word{i % 5} same{i % 5} text{i}", spec.TARGET_LABELS[i % 5], "en" if i % 2 else "de")
            for i in range(120)]
    df = spark.createDataFrame(rows, "key string, content string, emotion string, language string")
    root = tempfile.mkdtemp(prefix="lf-exp-")
    out = run_experiment(spark, df, df, "key", max_rounds=3, result_dir=root, name="m:x")
    got = {r["dataset"]: r for r in out.collect()}
    run = rep.read_runs(spark, root).first()
    assert run["model_name"] == "m:x" and run["has_model_info"] and run["has_training_metrics"] and run["has_evaluation"]
    assert run["epoch"] == got["test"]["best_epoch"] and run["test_acc"] == got["test"]["accuracy"]
    embedded = emb.embed_texts(df, "content", "e", 64, "none", True).withColumn("y", encode_label("emotion"))
    model = mdl.load_model(root + "/model")
    right = mdl.predict(model, embedded, "e").where(F.col("pred_label") == F.col("y")).count()
    assert right / len(rows) == got["test"]["accuracy"] > 0.5


def test_markdown_sink(spark):
    t = spark.createDataFrame([("m1", 1.5, 384)], f"`{rep.MODEL}` string, x double, y long")
    rows = rep.markdown_rows(t)
    assert rows.first()["markdown_row"] == "| m1 | 1.5000 | 384 |"
    path = tempfile.mkdtemp(prefix="lf-md-") + "/md"
    fio.write_markdown(t, rows, rep.markdown_header(t.columns), path)
    text = spark.read.text(path).collect()
    assert text[0][0].startswith("| Model Name | x | y |") and text[-1][0] == "| m1 | 1.5000 | 384 |"


def test_streaming_clean_matches_batch(spark):
    from labelforge.functions.text import clean_mail, drop_empty
    from labelforge.streaming.mail_stream import run_clean_stream
    src = tempfile.mkdtemp(prefix="lf-src-")
    views.raw_mail(spark, SF).write.mode("overwrite").parquet(src + "/part1")
    sink = tempfile.mkdtemp(prefix="lf-sink-") + "/out"
    run_clean_stream(spark, src + "/part1", sink, tempfile.mkdtemp(prefix="lf-ck-"))
    streamed = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    batch = drop_empty(clean_mail(views.raw_mail(spark, SF)), "preprocessed_text") \
        .select("doc_id", "preprocessed_text")
    assert streamed == sorted(tuple(r) for r in batch.collect())
    assert len(streamed) > 0


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["label", "class_name", "precision", "recall", "f1", "support"]
    assert df.count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())


ORACLE_SAMPLE = ["vote", "email_clean", "stratified_split", "pc_compat", "no_improve", "model_comparison",
                 "class_report", "dominant_label", "row_ids", "balance_classes"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


def test_oracle_agreement_sample(spark):
    import __spark_entry__ as e
    from labelforge.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, oracle = e.queries(), e.oracle_sql()
    for name in ORACLE_SAMPLE:
        df = qs[name](spark, SF)
        cols = df.columns
        got = sorted(tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
        res = con.execute(oracle[name])
        ocols = [d[0] for d in res.description]
        idx = [ocols.index(c) for c in sorted(cols)]
        want = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
        assert sorted(cols) == sorted(ocols), name
        assert got == want, name


def test_post_dataset_stages_are_reused(spark):
    from labelforge.plans.datasets import post_dataset
    stage_dir = tempfile.mkdtemp(prefix="lf-stages-")
    calls = []

    def client(key, text, system, prompt):
        calls.append(key)
        return "de:" + text

    first = sorted(tuple(r) for r in post_dataset(spark, SF, stage_dir=stage_dir, client=client).collect())
    n_calls = len(calls)
    second = sorted(tuple(r) for r in post_dataset(spark, SF, stage_dir=stage_dir, client=client).collect())
    assert first == second and len(first) > 0
    assert len(calls) == n_calls  # the translated stage was read back, no new calls


def test_throughput_records_encoder_failure(spark):
    from labelforge.operators import embed as emb

    def broken():
        def encode(texts):
            raise RuntimeError("device lost")
        return encode

    df = spark.createDataFrame([("a",), ("b",)], "text string")
    row = emb.encode_throughput(spark, df, "text", "broken-model", warmup_rows=1, make_encoder=broken).first()
    assert row["error"] and row["sentences_per_second"] is None
    ok = emb.encode_throughput(spark, df, "text", "hashing", warmup_rows=1).first()
    assert ok["error"] is None and ok["num_sentences_processed"] == 2 and ok["output_embedding_dim"] == 64


def test_post_dataset_can_drop_failed_translations(spark):
    from labelforge.plans.datasets import post_dataset
    kept = post_dataset(spark, SF)
    dropped = post_dataset(spark, SF, keep_failed=False)
    failed = kept.where(F.col("content") == spec.TRANSLATION_FAILED).count()
    assert failed > 0
    assert dropped.count() == kept.count() - 2 * failed


def test_latin1_csv(spark):
    path = tempfile.mkdtemp(prefix="lf-latin1-")
    with open(os.path.join(path, "posts.csv"), "w", encoding="latin-1") as f:
        f.write('"text","joy"\n"Grüße aus Köln","0.5"\n')
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("joy", T.DoubleType())])
    df = fio.read_csv(spark, path, schema, encoding="ISO-8859-1")
    assert [tuple(r) for r in df.collect()] == [("Grüße aus Köln", 0.5)]


PARTITION_INVARIANT = ["balance_classes", "shuffle_order", "stratified_split", "no_improve", "run_summary",
                       "vote", "class_report", "dedup_first", "model_comparison", "post_dataset"]


def test_same_answers_at_other_shuffle_partitions(spark):
    import __spark_entry__ as e
    qs = e.queries()
    results = {}
    for parts in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for name in PARTITION_INVARIANT:
            rows = qs[name](spark, SF).collect()
            results.setdefault(name, []).append(sorted(repr(tuple(r)) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for name, (a, b) in results.items():
        assert a == b, name


def test_event_sink_names_a_file_per_context(spark, tmp_path):
    from datetime import datetime
    at = [datetime(2024, 5, 1, 10, 0, s) for s in range(4)]
    rows = [("1", "a b/c", "inference_run", at[0], at[1], 1.0), ("2", "a b/c", "inference_run", at[1], at[3], 2.0),
            ("3", "z", "inference_run", at[0], at[2], 2.0), ("4", None, "inference_run", at[0], None, None)]
    events = spark.createDataFrame(rows, "event_id string, context_name string, event_type string, "
                                         "timestamp_start_iso timestamp, timestamp_end_iso timestamp, duration_seconds double")
    root = str(tmp_path / "events")
    assert not fio.write_events(events.where("false"), root) and not os.path.exists(root)
    assert fio.write_events(events, root)
    folders = sorted(x for x in os.listdir(root) if x.startswith("file="))
    assert folders[0] == "file=monitoring_events_a_b_c_20240501_100003.json"
    assert [x.rsplit("_", 2)[0] for x in folders] == [f"file=monitoring_events_{c}" for c in ("a_b_c", "none", "z")]
    valid, rejected = fio.read_event_lists(spark, root, spec.EVENT_SCHEMA, multiline=False)
    assert sorted(r["event_id"] for r in valid.collect()) == ["1", "2", "3"] and rejected.count() == 1
