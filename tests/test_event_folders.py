"""Folders that tasks of the event sink write themselves."""

import json
import os

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from labelforge.sources import files as fio


def _events(spark, n, contexts=3):
    at = F.timestamp_seconds(F.lit(1714557600) + F.col("id") % contexts)
    return spark.range(n).select(
        F.col("id").cast("string").alias("event_id"), F.concat(F.lit("ü "), F.col("id") % contexts).alias("context_name"),
        F.lit("inference_run").alias("event_type"), at.alias("timestamp_start_iso"), at.alias("timestamp_end_iso"),
        F.when(F.col("id") % 2 == 0, 0.5).alias("duration_seconds"), F.lit('say "no"\n\\').alias("note"))


def test_the_lines_are_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    events = _events(spark, 60).repartition(5)
    root, plain = str(tmp_path / "a"), str(tmp_path / "b")
    assert fio.write_events(events, root)
    monkeypatch.setattr(fio, "local_path", lambda spark, path: None)
    assert fio.write_events(events, plain)

    def held(path):
        return {folder: sorted(line for name in os.listdir(f"{path}/{folder}") if name.endswith(".json")
                               for line in open(f"{path}/{folder}/{name}", encoding="utf-8"))
                for folder in os.listdir(path) if folder.startswith("file=")}

    assert held(root) == held(plain) and len(held(root)) == 3
    assert sorted(os.listdir(root)) == sorted(x for x in os.listdir(plain) if not x.endswith(".crc"))
    assert fio.write_events(events.where("context_name = 'ü 1'"), root)   # the same rows once more
    assert held(root) == held(plain)


def test_local_folders_are_not_left_to_sparks_writer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrameWriter, "json", lambda *a, **k: 1 / 0)
    assert fio.write_events(_events(spark, 30), f"file://{tmp_path}/e f")
    assert fio.write_events(_events(spark, 30, 2), f"file:{tmp_path}/e f")
    assert sum(len(os.listdir(tmp_path / "e f" / x)) for x in os.listdir(tmp_path / "e f") if x.startswith("file=")) == 3
    assert fio.local_path(spark, "hdfs://store/x") is None and fio.local_path(spark, "viewfs://store/x") is None
    assert fio.local_path(spark, "file:///x/y") == fio.local_path(spark, "file:/x/y") == fio.local_path(spark, "/x/y") == "/x/y"


def test_a_repeated_task_loses_and_doubles_nothing(tmp_path):
    root, staging = str(tmp_path), str(tmp_path / ".staging")
    batch = pa.table({"file": ["a", "a", "b", "c"], "line": ["1\n", "2\n", "3\n", "4\n"]}).to_batches()[0]
    lost, kept = [[r for b in fio._write_pieces(iter([batch.slice(0, 1), batch.slice(1)]), staging) for r in b.to_pylist()]
                  for _ in range(2)]
    assert [r["file"] for r in kept] == ["a", "b", "c"] and not {r["piece"] for r in lost} & {r["piece"] for r in kept}
    os.makedirs(f"{root}/file=a/deeper")
    for name in ("file=a/part-old.json", "file=a/.part-old.json.crc"):
        open(f"{root}/{name}", "w").close()
    folders = pa.table({"file": [r["file"] for r in kept], "pieces": [[r["piece"]] for r in kept]}).to_batches()[0]
    for _ in range(2):   # the second finds its pieces moved
        assert sum(b["folders"][0].as_py() for b in fio._fill_folders(iter([folders]), root, staging)) == 3
        found = {f: [json.loads(x) for n in os.listdir(f"{root}/file={f}") for x in open(f"{root}/file={f}/{n}")] for f in "abc"}
        assert found == {"a": [1, 2], "b": [3], "c": [4]}


def test_many_folders_are_listed_by_a_few_tasks(spark, tmp_path):
    from labelforge import spec
    spark.range(50).select(F.col("id").alias("f"), F.col("id").cast("string").alias("event_id")) \
        .write.partitionBy("f").json(str(tmp_path / "e"))
    sc = spark.sparkContext
    sc.setJobGroup("listing", "listing")
    try:
        fio.read_event_lists(spark, str(tmp_path / "e"), spec.EVENT_SCHEMA, multiline=False)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("listing")]
        tasks = [sc.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 4 * sc.defaultParallelism < 50
    assert spark.conf.get(fio.LISTING, None) is None
