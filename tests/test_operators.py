"""Operators: invariants and edge cases."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.operators import annotate as ann
from labelforge.operators import evaluate as ev
from labelforge.operators import events as evt
from labelforge.operators import ranking as rk
from labelforge.operators import report as rep
from labelforge.operators import sampling as smp
from labelforge.operators import training as trn


def _skewed(spark, n=3000):
    rnd = random.Random(7)
    rows = [(i, "hot" if i % 3 else f"g{rnd.randint(0, 20)}", rnd.randint(0, 400), rnd.random())
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, t int, v double")


def test_bucketed_row_number_equals_plain(spark):
    df = _skewed(spark)
    got = rk.bucketed_row_number(df, ["g"], ["t", "id"], F.floor(F.col("t") / 37), "rn")
    plain = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")))
    j = got.join(plain, "id")
    assert j.where(F.col("rn") != F.col("rn2")).count() == 0
    assert j.count() == df.count()


def test_bucketed_row_number_global(spark):
    df = _skewed(spark)
    got = rk.bucketed_row_number(rk.ordered_buckets(df, [], ["id"], range_bytes=1000), [], ["id"], "_lf_b", "rn")
    assert sorted(r["rn"] for r in got.collect()) == list(range(1, df.count() + 1))
    assert got.where(F.col("rn") != F.col("id") + 1).count() == 0


def test_bucketed_prefix_equals_plain(spark):
    df = _skewed(spark)
    b = F.floor(F.col("t") / 50)
    for op, fn in (("min", F.min), ("max", F.max), ("sum", F.sum)):
        for inclusive in (True, False):
            got = rk.bucketed_prefix(df, ["g"], ["t", "id"], b, F.col("v"), op, "p", inclusive)
            frame = (Window.unboundedPreceding, 0 if inclusive else -1)
            plain = df.withColumn("p2", fn("v").over(Window.partitionBy("g").orderBy("t", "id")
                                                     .rowsBetween(*frame)))
            j = got.join(plain.select("id", "p2"), "id")
            bad = j.where(~(F.col("p").eqNullSafe(F.col("p2")) | (F.abs(F.col("p") - F.col("p2")) < 1e-9)))
            assert bad.count() == 0, (op, inclusive)


def test_balance_classes_equal_counts(spark):
    df = _skewed(spark)
    out = smp.balance_classes(df, "g", "id")
    counts = [r["count"] for r in out.groupBy("g").count().collect()]
    smallest = min(r["count"] for r in df.groupBy("g").count().collect())
    assert set(counts) == {smallest}
    assert len(counts) == df.select("g").distinct().count()


def test_split_quota_golden(spark):
    # 9,248 rows, validation share 0.3 -> 2,775 validation, 6,473 training rows
    sizes = [4000, 2000, 1500, 1000, 500, 248]
    counts = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "stratum string, n long")
    q = smp.split_quotas(counts, "stratum", 0.3)
    total_train = q.agg(F.sum("n_train")).first()[0]
    assert total_train == 6473
    assert sum(sizes) - total_train == 2775


def test_stratified_split_disjoint_exhaustive(spark):
    df = _skewed(spark)
    s = smp.stratified_split(df, ["g"], "id")
    assert s.count() == df.count()
    assert s.select("id").distinct().count() == df.count()
    n_val = s.where(F.col("split") == "val").count()
    import math
    assert n_val == math.ceil(0.3 * df.count())


def test_same_answer_across_shuffle_partitions(spark):
    df = _skewed(spark)
    results = []
    for parts in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(tuple(r) for r in smp.stratified_split(df, ["g"], "id")
                              .select("id", "split").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


def test_dedup_first_keeps_smallest_key(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "k long, t string")
    assert sorted(tuple(r) for r in smp.dedup_first(df, "t", "k").collect()) == [(1, "a"), (2, "b")]


def test_vote_golden(spark):
    seq = ["Joy", "Anger", "Anger", "Joy", "Fear"]

    def client(key, attempt, system, prompt):
        return '{"emotion": "%s"}' % seq[attempt]

    df = spark.createDataFrame([(1, "hello")], "email_id long, text string")
    v = ann.vote(ann.annotate(df, "email_id", "text", client), "email_id").first()
    assert v["emotion"] == "Joy"
    assert abs(v["confidence"] - 0.4) < 1e-12
    assert v["emotion_counts"] == '{"Anger":2,"Fear":1,"Joy":2}'
    assert [v[f"emotion_attempt_{i}"] for i in range(1, 6)] == seq


def test_annotate_failed_call_is_data(spark):
    def client(key, attempt, system, prompt):
        if attempt == 0:
            raise RuntimeError("quota")
        return '{"emotion": "Fear"}'

    df = spark.createDataFrame([(1, "x")], "email_id long, text string")
    rows = ann.attempts_long(ann.annotate(df, "email_id", "text", client, attempts=2), "email_id") \
        .orderBy("attempt_id").collect()
    assert (rows[0]["emotion"], rows[0]["success"]) == ("Anger", False)
    assert "quota" in rows[0]["error"]
    assert (rows[1]["emotion"], rows[1]["success"]) == ("Fear", True)


def test_prompts_reach_the_clients(spark):
    df = spark.createDataFrame([(1, "hello {text}")], "k long, t string")
    a = ann.annotate(df, "k", "t", lambda key, attempt, system, prompt: system + "|" + prompt, attempts=1)
    answer = a.select(F.col("attempts")[0]["error"].alias("e")).first()["e"]
    assert answer == "answer is not valid JSON"

    def echo(key, text, system, prompt):
        return f"{system}|{prompt}"
    for system, user in (ann.MAIL_PROMPTS, ann.POST_PROMPTS):
        got = ann.translate(df, "k", "t", echo, prompts=(system, user)).first()["raw_response"]
        assert got == system + "|" + user.replace("{text}", "hello {text}")

    def answering(key, attempt, system, prompt):
        ok = "expert emotion analyst" in system and "* Joy" in system and prompt.endswith("Email:\nhello {text}\n\n")
        return '{"emotion": "Joy"}' if ok else "wrong"
    assert ann.annotate(df, "k", "t", answering, attempts=1).first()["attempts"][0]["emotion"] == "Joy"


def test_class_weights_enter_the_fit(spark):
    from labelforge.operators import model as mdl
    rows = [(i, 0) for i in range(900)] + [(900 + i, 1) for i in range(100)] + [(1000, 2), (1001, None)]
    df = spark.createDataFrame(rows, "k long, y int")
    w = spark.createDataFrame([(0, 0.8), (1, 2.2), (3, None)], "label int, weight_tempered double")
    out = mdl._copies(df, "y", w, F.col("k"))
    n = {r["y"]: r["n"] for r in out.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n[0] == 900 and n[2] == 1 and n[None] == 1
    assert 260 <= n[1] <= 290  # 2.75 times
    assert out.where("_lf_copy = 0").count() == len(rows)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mdl._copies(df.repartition(7), "y", w, F.col("k")).collect()))


def test_run_matrix_makes_one_run_per_line(spark):
    from labelforge.plans.experiment import run_matrix
    seen = []

    def run(name, normalize, prefix):
        seen.append((name, normalize, prefix))
        return spark.createDataFrame([(len(seen),)], "n int")
    rows = run_matrix(["a;True;none", "", " b ; false ; query "], run).orderBy("n").collect()
    assert seen == [("a", True, "none"), ("b", False, "query")]
    assert [(r["model_name"], r["normalize"], r["prefix_function"]) for r in rows] == seen


def test_translate_statuses(spark):
    df = spark.createDataFrame([(1, None), (2, "   "), (13, "fails"), (3, " hi ")], "k long, t string")
    out = {r["k"]: r for r in ann.translate(df, "k", "t").collect()}
    assert (out[1]["translated_text"], out[1]["success"]) == (spec.EMPTY_TEXT, True)
    assert (out[2]["translated_text"], out[2]["success"]) == (spec.EMPTY_TEXT, True)
    assert (out[13]["translated_text"], out[13]["success"]) == (spec.TRANSLATION_FAILED, False)
    assert out[13]["error"]
    assert out[3]["translated_text"] == "de: hi"


def test_class_report_unpredicted_class(spark):
    rows = [(0, 0), (1, 0), (2, 2), (2, 2)]
    df = spark.createDataFrame(rows, "t int, p int")
    long = ev.confusion_long(df, "t", "p", ["a", "b", "c"])
    assert long.agg(F.sum("n")).first()[0] == len(rows)
    rep_ = {r["label"]: r for r in ev.class_report(long, ["a", "b", "c"]).collect()}
    assert rep_[1]["precision"] == 0.0 and rep_[1]["f1"] == 0.0 and rep_[1]["support"] == 1
    assert abs(rep_[0]["precision"] - 0.5) < 1e-12
    counts = ev.confusion_counts(df, "t", "p")
    s = ev.report_summary(ev.class_report(long, ["a", "b", "c"]), counts, k=3).first()
    assert abs(s["accuracy"] - 0.75) < 1e-12
    assert abs(s["weighted_recall"] - s["accuracy"]) < 1e-12


def test_accuracy_zero_when_label_outside(spark):
    df = spark.createDataFrame([(0, 0), (1, 5)], "t int, p int")
    long = ev.confusion_long(df, "t", "p", ["a", "b"])
    s = ev.report_summary(ev.class_report(long, ["a", "b"]), ev.confusion_counts(df, "t", "p"), k=2).first()
    assert s["accuracy"] == 0.0


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    w = {r["label"]: r for r in ev.class_weights(df, "y", k=3).collect()}
    assert abs(w[0]["weight"] - 4 / 9) < 1e-12
    assert abs(w[1]["weight_tempered"] - (4 / 3) ** 0.5) < 1e-12
    assert w[2]["weight"] is None


def _series(spark, losses, run=1):
    return spark.createDataFrame(
        [(run, e, loss / 2, 0.5, loss, 0.5, 1e-4) for e, loss in enumerate(losses)],
        "run_id long, epoch long, train_loss double, train_acc double, val_loss double, "
        "val_acc double, learning_rate double")


def test_early_stop_and_best_epoch(spark):
    losses = [5.0, 4.0, 3.0, 3.0, 3.5] + [4.0] * 20
    ran = trn.ran_epochs(_series(spark, losses), patience=10)
    s = trn.run_summary(ran, patience=10).first()
    assert s["best_epoch"] == 2            # equal minima -> the earlier epoch
    assert s["epochs_ran"] == 13           # series ends patience epochs after the best
    assert s["early_stop_triggered"] is True
    b = trn.best_epoch(ran).first()
    assert b["best_epoch"] == 2 and b["best_val_loss"] == 3


def test_epoch_lookup_out_of_range(spark):
    series = _series(spark, [3.0, 2.0, 1.0])
    pts = spark.createDataFrame([(1, 1), (1, 9)], "run_id long, epoch long")
    out = {r["epoch"]: r["val_loss"] for r in trn.epoch_lookup(pts, series, ["val_loss"]).collect()}
    assert out == {1: 2.0, 9: None}


def test_event_metrics_guards(spark):
    df = spark.createDataFrame(
        [(1, "inference_run", 2.0, 0, 0, 10.0), (2, "inference_run", 2.0, 4, 400, None),
         (3, "inference_run", 4.0, 4, 400, 300.0)],
        "event_id long, event_type string, duration_seconds double, num_texts_processed long, "
        "total_chars_processed long, ram_usage_delta_mb double")
    m = {r["event_id"]: r for r in evt.event_metrics(df).collect()}
    assert m[1]["seconds_per_text"] is None and m[1]["seconds_per_1k_chars"] is None
    assert m[2]["seconds_per_text"] == 0.5 and m[2]["seconds_per_1k_chars"] == 5.0
    pc = evt.pc_compatibility(evt.event_metrics(df)).collect()
    by = {(r["event_id"], r["profile"]): r for r in pc}
    assert by[(2, None)]["status"] == "insufficient data"
    low = spec.PC_PROFILES[0][0]
    assert by[(3, low)]["status"] == "compatible"      # exactly at the limits (300 MB, 1.0 s)
    assert by[(3, low)]["notes"] == f"Likely compatible with: {low}"
    high = spec.PC_PROFILES[2][0]
    assert "takes 1.0000s/email, profile target <0.10s" in by[(3, high)]["notes"]


def test_comparison_rules(spark):
    perf = spark.createDataFrame(
        [("m1", "gpu", "t1", 100.0, 384, 50.0), ("m1", "gpu", "t2", 200.0, 384, 60.0),
         ("m1", "cpu-a", "t1", 10.0, 384, None)],
        "model_name string, device string, timestamp string, sentences_per_second double, "
        "output_embedding_dim long, gpu_memory_allocated_mb double")
    runs = spark.createDataFrame(
        [("m1", "balanced", 768, 3, True, True, 0.9, 0.8, 0.3),
         ("m2", "balanced-de", 512, 5, True, True, 0.7, 0.6, 0.2),
         ("m2", "balanced-en", 512, 5, False, True, 0.7, 0.6, 0.2)],
        "model_name string, dataset string, embedding_dimension long, epoch long, "
        "has_training_metrics boolean, has_evaluation boolean, train_acc double, val_acc double, test_acc double")
    t = {r[rep.MODEL]: r for r in rep.comparison(perf, runs, ["cpu-a"]).collect()}
    assert t["m1"][rep.DIMENSION] == 384          # performance wins
    assert t["m2"][rep.DIMENSION] == 512          # classification fills
    assert t["m1"][rep.GPU_SPEED] == 200.0        # newest file wins
    assert t["m1"][rep.MEMORY] == 60.0
    assert t["m1"]["de/en - test acc"] == 0.3
    assert t["m2"]["en - test acc"] is None       # run without training metrics skipped
    bad = rep.incomplete_runs(runs).collect()
    assert [(r["model_name"], r["reason"]) for r in bad] == [("m2", "missing training_metrics.json")]


def test_mlp_forward_relu_then_linear(spark):
    import numpy as np
    from labelforge.operators import model as mdl
    w1 = np.array([[1.0, -1.0], [0.5, 0.5]])
    b1 = np.array([0.0, 0.0])
    w2 = np.array([[1.0, 0.0, 2.0], [0.0, 1.0, -1.0]])
    b2 = np.array([0.1, 0.2, 0.3])
    udf = mdl.mlp_forward_udf([(w1, b1), (w2, b2)], batch_size=2)
    df = spark.createDataFrame([([1.0, 2.0],), ([-3.0, 0.0],)], "x array<float>")
    out = [r[0] for r in df.select(udf("x")).collect()]
    for x, got in zip([[1.0, 2.0], [-3.0, 0.0]], out):
        h = np.maximum(np.array(x) @ w1 + b1, 0)
        want = h @ w2 + b2
        assert np.allclose(got, want, atol=1e-5)


def test_required_and_fallback_columns(spark):
    import pytest
    df = spark.createDataFrame([("a", 1.0)], "sentence string, joy double")
    assert spec.resolve_column(df, ["text", "sentence"]) == "sentence"
    assert spec.resolve_column(df, ["text"]) is None
    with pytest.raises(ValueError):
        spec.require_columns(df, ["content", "sentiment"])


def test_ordered_buckets_cut_any_spread(spark):
    # two thirds of the rows share one key, one value is an early outlier, a
    # burst shares one second, and some rows have no order value at all
    df = _skewed(spark, 6000).withColumn("t", F.when(F.col("id") == 5, -10 ** 9).when(F.col("id") % 50 == 0, None)
                                         .when(F.col("id") > 3000, 77).otherwise(F.col("id")))
    b = rk.ordered_buckets(df, ["g"], ["t", "id"], range_bytes=2000)
    sizes = [r["count"] for r in b.where(F.col("g") == "hot").groupBy("_lf_b").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 3000
    got = rk.bucketed_row_number(b, ["g"], ["t", "id"], "_lf_b", "rn")
    plain = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")))
    assert got.count() == df.count()
    assert got.join(plain, "id").where(F.col("rn") != F.col("rn2")).count() == 0


def test_rows_without_a_key_stay(spark):
    rows = [(None, "a", 1), (1, "a", 1), (2, "b", None), (3, "b", 2)]
    df = spark.createDataFrame(rows, "id long, g string, h int")
    assert smp.row_ids(df, "id").count() == 4
    assert smp.shuffle_rank(df, "id").count() == 4
    assert smp.stratified_split(df, ["g", "h"], "id").count() == 4
    assert smp.balance_classes(df, "g", "id").count() == 4
    series = spark.createDataFrame([(1, None, 2.0), (1, 0, 1.0), (1, 1, 3.0)], "run_id long, epoch long, val_loss double")
    assert trn.no_improvement(series).count() == 3


def test_strata_with_the_same_text_stay_apart(spark):
    rows = [(i, "a_b", "c") for i in range(10)] + [(i, "a", "b_c") for i in range(10, 20)] + [(20, "a", None), (21, "a", "x")]
    out = smp.stratified_split(spark.createDataFrame(rows, "id long, x string, y string"), ["x", "y"], "id")
    n = {(r.x, r.y): r.n for r in out.where("split = 'train'").groupBy("x", "y").agg(F.count("*").alias("n")).collect()}
    assert n[("a_b", "c")] == n[("a", "b_c")] == 7


def test_report_counts_pairs_outside_the_taxonomy(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 7), (1, 1), (7, 1)], "true_label int, pred_label int")
    counts = ev.confusion_counts(pairs, "true_label", "pred_label")
    rep = {r.label: r for r in ev.class_report(ev.confusion_long_from_counts(counts), counts=counts).collect()}
    assert (rep[0].precision, rep[0].recall, rep[0].support) == (1.0, 0.5, 2)
    assert (rep[1].precision, rep[1].recall, rep[1].support) == (0.5, 1.0, 1)


def test_csv_keeps_white_space(spark, tmp_path):
    from labelforge.sources import files
    df = spark.createDataFrame([(1, "  lead"), (2, "trail \t"), (3, "a\n b ")], "k int, text string")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_checkpoint_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from labelforge.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    conf = SimpleNamespace(get=lambda k, d=None: d)
    with pytest.raises(RuntimeError, match="checkpoint"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_scale_conf_sizes_partitions():
    from labelforge.session import scale_conf
    c = scale_conf(100 << 40, executor_cores=4000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600  # 100 TB / 256 MB
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = scale_conf(1 << 30, executor_cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16


def test_drop_duplicate_columns(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([(1, "y")], "k long, v string")
    j = a.join(b, a["k"] == b["k"])
    assert j.columns == ["k", "v", "k", "v"]
    out = spec.drop_duplicate_columns(j)
    assert out.columns == ["k", "v"] and tuple(out.first()) == (1, "x")


def test_report_json_single_record(spark):
    import json
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "t int, p int")
    counts = ev.confusion_counts(df, "t", "p")
    long = ev.confusion_long_from_counts(counts, ["a", "b"])
    rep_ = ev.class_report(long, ["a", "b"])
    rec = json.loads(ev.report_json(long, rep_, ev.report_summary(rep_, counts, k=2)).first()["evaluation_json"])
    assert rec["confusion_matrix"] == [[1, 0], [1, 1]]
    assert abs(rec["accuracy"] - 2 / 3) < 1e-12
    got = rec["classification_report"]
    assert list(got) == ["a", "b", "accuracy", "macro avg", "weighted avg"]
    assert got["b"] == {"precision": 1.0, "recall": 0.5, "f1-score": 2 / 3, "support": 2.0}
    assert got["accuracy"] == rec["accuracy"] and got["macro avg"]["recall"] == 0.75
    assert got["weighted avg"]["support"] == 3.0
    outside = ev.confusion_counts(df.unionByName(spark.createDataFrame([(0, 7)], "t int, p int")), "t", "p")
    report = ev.class_report(ev.confusion_long_from_counts(outside, ["a", "b"]), ["a", "b"], counts=outside)
    rec = json.loads(ev.report_json(long, report, ev.report_summary(report, outside, k=2)).first()["evaluation_json"])
    assert rec["accuracy"] == 0.0 and "accuracy" not in rec["classification_report"]


def test_split_quotas_at_large_counts(spark):
    # counts whose products overflow 64-bit integers
    sizes = [60_000_000_000, 30_000_000_001, 9_999_999_999]
    counts = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "stratum string, n long")
    q = {r["stratum"]: r["n_train"] for r in smp.split_quotas(counts, "stratum", 0.3).collect()}
    total = sum(sizes)
    import math
    n_train = total - math.ceil(0.3 * total)
    assert sum(q.values()) == n_train
    for i, n in enumerate(sizes):  # each stratum within one of its exact share
        assert abs(q[f"s{i}"] - n * n_train / total) < 1.0


def test_hashing_tf_embed_is_jvm_and_normalised(spark):
    from labelforge.operators import embed as emb
    df = spark.createDataFrame([(1, "Hello hello world"), (2, ""), (3, None)], "k long, t string")
    out = emb.hashing_tf_embed(df, "t", dim=16, prefix_name="query").orderBy("k").collect()
    assert all(len(r["embedding"]) == 16 for r in out)
    assert abs(sum(x * x for x in out[0]["embedding"]) - 1.0) < 1e-5
    plan = emb.hashing_tf_embed(df, "t", dim=16)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
