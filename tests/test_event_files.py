"""Files of the event sink."""

import glob

from pyspark.sql import functions as F

from labelforge.sources import files as fio


def test_a_context_has_one_file_however_many_tasks_read_it(spark, tmp_path, monkeypatch):
    rows = [(str(i), f"c{i % 3}", "inference_run", 1.0) for i in range(120)]
    at = F.timestamp_seconds(F.col("event_id").cast("int"))
    events = spark.createDataFrame(rows, "event_id string, context_name string, event_type string, duration_seconds double") \
        .withColumns({"timestamp_start_iso": at, "timestamp_end_iso": at}).repartition(6)
    root = str(tmp_path / "events")
    assert fio.write_events(events, root)
    assert len(glob.glob(f"{root}/file=*/*.json")) == len(glob.glob(f"{root}/file=*")) == 3
    monkeypatch.setattr(fio, "EVENTS_A_FILE", 10)   # hot contexts
    assert fio.write_events(events, root)
    assert len(glob.glob(f"{root}/file=*")) == 3 < len(glob.glob(f"{root}/file=*/*.json")) <= 12
    assert spark.read.json(root).count() == 120
