"""The trained network, its model table, and the file readers, against plain versions."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.operators import evaluate as ev
from labelforge.operators import model as mdl
from labelforge.operators import network as net
from labelforge.operators import report as rep
from labelforge.sources import files as fio

K, DIM = 3, 6


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    y = rng.choice(K, 240, p=[0.7, 0.2, 0.1])
    x = rng.normal(size=(240, DIM)) + 1.5 * np.eye(DIM)[y]
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(240)]
    df = spark.createDataFrame(rows + [(900, None, 1), (901, [0.0] * DIM, None)], "k long, x array<double>, y int")
    return df, x, y, ev.class_weights(df, "y", K)


def plain_losses(x, y, w, weights):
    """Weighted mean cross-entropy by its definition, one row at a time."""
    total = 0.0
    for row, label in zip(x, y):
        h = row
        for i, (m, b) in enumerate(weights):
            h = np.array([sum(h[a] * m[a, c] for a in range(len(h))) + b[c] for c in range(len(b))])
            if i < len(weights) - 1:
                h = np.array([max(v, 0.0) for v in h])
        total += w[label] * (np.log(sum(np.exp(v) for v in h)) - h[label])
    return total / sum(w[label] for label in y)


def class_weight(weights):
    return {r["label"]: r["weight_tempered"] for r in weights.collect()}


def test_one_step_equals_a_plain_gradient(spark, data):
    df, x, y, weights = data
    staged, dim = net.staged_batches(df.repartition(5), "x", "y", weights, "k", 1000, 42)
    assert dim == DIM and len(staged) == 1
    w = class_weight(weights)
    start = net.initial_weights([DIM, 4, K], 1)
    s = net.batch_sums(staged[0], start)
    assert (s.rows, s.right) == (240, int((net.forward(x, start)[-1].argmax(axis=1) == y).sum()))
    assert s.loss / s.weight == pytest.approx(plain_losses(x, y, w, start), rel=1e-12)
    step = 1e-6
    for layer, which, at in ((0, 0, (2, 1)), (0, 1, (3,)), (1, 0, (0, 2)), (1, 1, (1,))):
        up, down = [[(m.copy(), b.copy()) for m, b in start] for _ in range(2)]
        up[layer][which][at] += step
        down[layer][which][at] -= step
        slope = (plain_losses(x, y, w, up) - plain_losses(x, y, w, down)) / (2 * step)
        assert s.gradients[2 * layer + which][at] / s.weight == pytest.approx(slope, rel=1e-4, abs=1e-8)


def test_many_partitions_combine_alike(spark, data, monkeypatch):
    df, x, y, weights = data
    monkeypatch.setattr(net, "STAGE_BYTES", 500)
    staged, _ = net.staged_batches(df, "x", "y", weights, "k", 1000, 42)
    start = net.initial_weights([DIM, 4, K], 1)
    one = net.batch_sums(staged[0], start)
    monkeypatch.setattr(net, "WIDE", 0)
    other = net.batch_sums(staged[0], start)
    assert one.rows == other.rows == 240
    assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(one.gradients, other.gradients))


def test_one_epoch_equals_a_plain_loop(spark, data):
    df, x, y, weights = data
    w = class_weight(weights)
    staged, _ = net.staged_batches(df, "x", "y", weights, "k", 60, 42)
    assert len(staged) == 4
    start = net.initial_weights([DIM, 4, K], 1)
    order = np.array([2, 0, 3, 1])
    got, loss, acc = net.run_epoch(staged, start, net.Adam(0.05), order)
    batch = df.where("x is not null and y is not null").select(
        "k", F.pmod(F.xxhash64("k", F.lit(42)), F.lit(4)).alias("b")).collect()
    rows = {b: sorted(r.k for r in batch if r.b == b) for b in range(4)}
    model, mean, square, losses = start, [0.0] * 4, [0.0] * 4, []
    for t, b in enumerate(order, 1):
        at = rows[b]
        s = net.loss_sums(x[at], y[at], np.array([w[v] for v in y[at]]), model)
        losses.append((plain_losses(x[at], y[at], w, model), len(at), s.right))
        flat = []
        for i, g in enumerate(s.gradients):
            g = g / s.weight
            mean[i], square[i] = 0.9 * mean[i] + 0.1 * g, 0.999 * square[i] + 0.001 * g * g
            flat.append(model[i // 2][i % 2] - 0.05 * (mean[i] / (1 - 0.9 ** t)) / (np.sqrt(square[i] / (1 - 0.999 ** t)) + 1e-8))
        model = [(flat[0], flat[1]), (flat[2], flat[3])]
    assert loss == pytest.approx(sum(a * n for a, n, _ in losses) / 240, rel=1e-12)
    assert acc == sum(c for _, _, c in losses) / 240
    assert all(np.allclose(a, b, rtol=1e-9) for p, q in zip(got, model) for a, b in zip(p, q))
    val_loss, val_acc = net.evaluate_batches(staged, got)
    plain = [plain_losses(x[rows[b]], y[rows[b]], w, got) * len(rows[b]) for b in range(4)]
    assert val_loss == pytest.approx(sum(plain) / 240, rel=1e-12)
    assert val_acc == (net.forward(x, got)[-1].argmax(axis=1) == y).mean()


def test_training_stops_keeps_the_best_and_agrees_on_a_rerun(spark, data):
    df, x, y, weights = data
    train, val = df.where("k % 3 != 0"), df.where("k % 3 = 0")
    run = lambda d: net.train_network(d, val, "x", "y", weights, K, "k", (8,), 0.05, 80, 30, patience=3)
    best, rows = run(train)
    losses = [r[3] for r in rows]
    first = losses.index(min(losses))
    assert len(rows) == min(30, first + 4) and rows[first][5]
    assert [r[6] for r in rows] == sorted((r[6] for r in rows), reverse=True) and rows[0][6] == 0.05
    again, series = run(train.repartition(7))
    assert [r[:2] for r in series] == [r[:2] for r in rows]
    assert all((a == b).all() for p, q in zip(best, again) for a, b in zip(p, q))
    assert max(r[4] for r in rows) > 0.8
    assert net.train_network(df.limit(0), val, "x", "y", weights, K, "k") == ([], [])


def test_plateau():
    p, rate, rates = net.Plateau(0.1, 2), 1.0, []
    for loss in (5, 4, 4, 4, 4, 4, 4, 4, 3, 3):
        rate = p.rate(rate, loss)
        rates.append(round(rate, 9))
    assert rates == [1, 1, 1, 1, 0.1, 0.1, 0.1, 0.01, 0.01, 0.01]


@pytest.mark.parametrize("block", [2, 4, 1024])
def test_model_table_shipped_and_joined_predict_the_same(spark, data, block, monkeypatch):
    df, x, y, _ = data
    monkeypatch.setattr(net, "GROUP_ROWS", 50)
    weights = net.initial_weights([DIM, 5, 4, K], 3)
    path = tempfile.mkdtemp(prefix="lf-net-") + "/m"
    net.save_network(spark, weights, path, block)
    table = net.load_network(spark, path)
    want = net.forward(x, weights)[-1]
    for most in (0, 10_000):
        got = {r.k: r.logits for r in net.apply_network(df, table, "x", max_shipped=most).collect()}
        assert got[900] is None and len(got) == 242
        assert np.allclose([got[i] for i in range(240)], want, rtol=1e-12)
    labels = {r.k: r.pred_label for r in mdl.predict(mdl.load_model(path), df, "x", max_shipped=0).collect()}
    assert labels[900] is None and [labels[i] for i in range(240)] == list(want.argmax(axis=1))


def test_batched_loss_is_the_mean_over_batches(spark, data):
    df, _, _, _ = data
    got = ev.batched_log_loss(df.where("x is not null").withColumn("l", F.slice("x", 1, K)), "l", "y", "k", 50, K).first()
    assert (got.n, got.batches) == (240, 5) and got.loss > 0 and 0 < got.acc < 1
    none = ev.batched_log_loss(df.limit(0).withColumn("l", F.slice("x", 1, K)), "l", "y", "k", 50, K).first()
    assert (none.loss, none.acc, none.n, none.batches) == (None, None, 0, 0)


def test_encoding_is_chosen_per_file(spark):
    root = tempfile.mkdtemp(prefix="lf-enc-")
    for name, encoding, rows in (("a", "utf-8", ["ä1", "中\n2"]), ("b", "latin-1", ["ü3", "é\n4"]), ("c", "ascii", ["x"])):
        with open(f"{root}/{name}.csv", "wb") as f:
            f.write(('"t","n"\n' + "".join(f'"{r}","1"\n' for r in rows)).encode(encoding))
    open(f"{root}/empty.csv", "w").close()
    schema = "t string, n int"
    from pyspark.sql.types import _parse_datatype_string
    got = fio.read_csv_folder(spark, root, _parse_datatype_string(schema))
    assert sorted(r.t for r in got.collect()) == sorted(["ä1", "中\n2", "ü3", "é\n4", "x"])
    named = {os.path.basename(r.file): r.encoding for r in fio.file_encodings(spark, root).collect()}
    assert named == {"a.csv": "UTF-8", "b.csv": "ISO-8859-1", "c.csv": "UTF-8"}
    assert fio.read_csv_folder(spark, root + "/none", _parse_datatype_string(schema)) is None


def test_event_arrays_set_elements_aside(spark):
    root = tempfile.mkdtemp(prefix="lf-arr-")
    good = {f.name: "1" for f in spec.EVENT_SCHEMA.fields}
    good |= {"event_type": "inference_run", "timestamp_start_iso": "2024-01-01T00:00:00", "timestamp_end_iso": "2024-01-01T00:00:01",
             "duration_seconds": 1.5, "num_texts_processed": 7}
    lacking = {k: v for k, v in good.items() if k != "event_id"}
    items = [good | {"event_id": "a"}, lacking, good | {"event_id": "b", "num_texts_processed": "many"}, 5,
             good | {"event_id": "c", "event_type": "model_load"}, good | {"event_id": "d", "num_texts_processed": None}]
    for name, text in (("x", json.dumps(items)), ("y", "[{broken"), ("z", "[]"), ("o", "{}")):
        with open(f"{root}/{name}.json", "w") as f:
            f.write(text)
    valid, rejected = fio.read_event_arrays(spark, root, spec.EVENT_SCHEMA)
    got = {r.event_id: r for r in valid.collect()}
    assert set(got) == {"a", "d"} and got["a"].duration_seconds == 1.5 and got["a"].num_texts_processed == 7
    assert got["d"].num_texts_processed is None
    texts = [r._corrupt_record for r in rejected.collect()]
    assert len(texts) == 5 and "[{broken" in texts and "{}" in texts and "5" in texts


def test_first_file_of_a_leaf_counts(spark):
    root = tempfile.mkdtemp(prefix="lf-leaf-")
    for leaf, name, dim in (("cpu-a/1/m", "a.json", 1), ("cpu-a/1/m", "b.json", 2), ("gpu/1/m", "c.json", 3)):
        os.makedirs(f"{root}/{leaf}", exist_ok=True)
        with open(f"{root}/{leaf}/{name}", "w") as f:
            json.dump({"model_name": "m", "output_embedding_dim": dim}, f)
    read = lambda one: sorted((r.d, r.output_embedding_dim) for r in fio.read_json_tree(
        spark, root, spec.PERFORMANCE_SCHEMA, ["d", "t", "m"], one_per_leaf=one).collect())
    assert read(True) == [("cpu-a", 1), ("gpu", 3)] and len(read(False)) == 3


def test_any_cpu_device_has_its_column(spark):
    rows = [("m", d, "1", float(i), 4, None) for i, d in enumerate(["cpu-new", "CPU-b", "gpu-cpu", "GPU", "tpu", None])]
    perf = spark.createDataFrame(rows, "model_name string, device string, timestamp string, sentences_per_second double, "
                                 "output_embedding_dim long, gpu_memory_allocated_mb double")
    devices = rep.cpu_devices(perf)
    assert devices == ["CPU-b", "cpu-new"]
    assert rep.comparison_columns(devices)[-1] == "Encoding Speed (Sentences/Sec) cpu-new"


def test_event_sink_reruns_replace_their_contexts(spark):
    root = tempfile.mkdtemp(prefix="lf-sink-") + "/e"
    rows = [(str(i), f"c{i % 2}", "inference_run", "2024-01-01 00:00:00", "2024-01-01 00:00:01", 1.0) for i in range(6)]
    e = spark.createDataFrame(rows, "event_id string, context_name string, event_type string, a string, b string, duration_seconds double")
    e = e.select("event_id", "context_name", "event_type", F.col("a").cast("timestamp").alias("timestamp_start_iso"),
                 F.col("b").cast("timestamp").alias("timestamp_end_iso"), "duration_seconds")
    assert fio.write_events(e, root) and fio.write_events(e.where("context_name = 'c0'"), root)
    valid, _ = fio.read_event_lists(spark, root, spec.EVENT_SCHEMA, multiline=False)
    assert sorted(r.event_id for r in valid.collect()) == [str(i) for i in range(6)]
    assert not fio.write_events(e.limit(0), root)
