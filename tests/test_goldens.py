"""Golden values: published evaluation, training and monitoring results.

The numbers below are copied as literal fixtures from checked-in result
files of the original experiments (a test-set confusion matrix with its
report, one validation-loss series, one monitoring event list, one
throughput record).  The operators must reproduce the stored derived values.
"""

from pyspark.sql import functions as F

from labelforge.operators import evaluate as ev
from labelforge.operators import events as evt
from labelforge.operators import training as trn

# FIXED VALUES: test-set confusion matrix (rows = true, columns = predicted;
# order Anger, Neutral, Joy, Sadness, Fear) and the stored report.
GOLDEN_CONFUSION = [
    [7805, 2799, 5236, 4070, 1099],
    [5544, 4585, 6875, 2859, 1149],
    [715, 2961, 15838, 1307, 191],
    [4732, 2530, 3474, 9060, 1213],
    [3156, 4574, 5026, 5723, 2528],
]
GOLDEN_REPORT = {
    "Anger": (0.3555484693877551, 0.37150744918844303, 0.36335280836107164, 21009),
    "Neutral": (0.26276577454295375, 0.21820864268037313, 0.23842333792673098, 21012),
    "Joy": (0.43452495267359875, 0.7537597563297164, 0.5512608551887367, 21012),
    "Sadness": (0.3935879056431643, 0.431243752677424, 0.41155628236576725, 21009),
    "Fear": (0.4090614886731392, 0.1203408387680297, 0.18597123625262074, 21007),
}
GOLDEN_ACCURACY = 0.37902312254281334
GOLDEN_MACRO = (0.37109771818412224, 0.3790120879287972, 0.3501129040189854)
GOLDEN_WEIGHTED = (0.37109571300874283, 0.37902312254281334, 0.35011858383022376)

# FIXED VALUES: validation loss per epoch (6 decimals) of one run; the stored
# best epoch is 39 and the series stops 10 epochs later (patience 10).
GOLDEN_VAL_LOSS = [
    1.236087, 1.118069, 1.050846, 0.995297, 0.952412, 0.920472, 0.892241, 0.874233, 0.856343, 0.841839,
    0.830985, 0.821563, 0.811601, 0.804188, 0.796983, 0.792541, 0.787686, 0.783975, 0.780267, 0.776668,
    0.774183, 0.770556, 0.766041, 0.763231, 0.760854, 0.758492, 0.755884, 0.756177, 0.754758, 0.754731,
    0.7535, 0.752934, 0.750619, 0.749767, 0.748532, 0.748383, 0.74781, 0.748125, 0.747188, 0.745573,
    0.746936, 0.749725, 0.747186, 0.748178, 0.748896, 0.749623, 0.748951, 0.749704, 0.750417, 0.750792,
]
GOLDEN_BEST_EPOCH = 39

# FIXED VALUES: inference events (duration s, texts, characters) and the stored
# avg chars per text, seconds per text, seconds per 1k characters.
GOLDEN_EVENTS = [
    (4.418092204, 6473, 10594459, 1636.7154333384829, 0.0006825416659972191, 0.000417019142176113),
    (1.83525165, 2775, 4754843, 1713.456936936937, 0.0006613519459459459, 0.0003859752361960216),
    (9.799889088, 105049, 9569203, 91.09275671353369, 9.328874228217308e-05, 0.0010241071370311614),
]


def _close(a, b, tol=1e-12):
    return abs(a - b) <= tol


def test_golden_classification_report(spark):
    names = list(GOLDEN_REPORT)
    rows = [(t, p, n) for t, row in enumerate(GOLDEN_CONFUSION) for p, n in enumerate(row)]
    counts = spark.createDataFrame(rows, "true_label int, pred_label int, n long")
    long = ev.confusion_long_from_counts(counts, names)
    report = {r["class_name"]: r for r in ev.class_report(long, names).collect()}
    for name, (p, r, f1, support) in GOLDEN_REPORT.items():
        got = report[name]
        assert _close(got["precision"], p) and _close(got["recall"], r) and _close(got["f1"], f1), name
        assert got["support"] == support
    s = ev.report_summary(ev.class_report(long, names), counts, k=5).first()
    assert _close(s["accuracy"], GOLDEN_ACCURACY)
    assert _close(s["macro_precision"], GOLDEN_MACRO[0]) and _close(s["macro_recall"], GOLDEN_MACRO[1])
    assert _close(s["macro_f1"], GOLDEN_MACRO[2])
    assert _close(s["weighted_precision"], GOLDEN_WEIGHTED[0]) and _close(s["weighted_recall"], GOLDEN_WEIGHTED[1])
    assert _close(s["weighted_f1"], GOLDEN_WEIGHTED[2])
    assert s["support"] == 105049


def test_golden_early_stop(spark):
    rows = [(1, e, v / 2, 0.5, v, 0.5, 1e-4) for e, v in enumerate(GOLDEN_VAL_LOSS)]
    series = spark.createDataFrame(rows, "run_id long, epoch long, train_loss double, train_acc double, "
                                         "val_loss double, val_acc double, learning_rate double")
    s = trn.run_summary(trn.ran_epochs(series, patience=10), patience=10).first()
    assert s["best_epoch"] == GOLDEN_BEST_EPOCH
    assert s["epochs_ran"] == len(GOLDEN_VAL_LOSS) == GOLDEN_BEST_EPOCH + 10 + 1
    assert s["early_stop_triggered"] is True


def test_golden_event_derivations(spark):
    rows = [(i, "inference_run", d, n, c) for i, (d, n, c, *_ ) in enumerate(GOLDEN_EVENTS)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, duration_seconds double, "
                                     "num_texts_processed long, total_chars_processed long")
    got = {r["event_id"]: r for r in evt.event_metrics(df).collect()}
    for i, (_, _, _, avg, spt, sp1k) in enumerate(GOLDEN_EVENTS):
        assert got[i]["avg_chars_per_text"] == avg
        assert got[i]["seconds_per_text"] == spt
        assert got[i]["seconds_per_1k_chars"] == sp1k


def test_golden_throughput():
    # 1,000,000 sentences in 75.21 s -> 13296.1 sentences per second
    assert evt.throughput(1_000_000, 75.21) == 13296.1


def test_golden_split_counts(spark):
    from labelforge.operators import sampling as smp
    # 9,248 training texts -> 2,775 validation rows (6,473 training)
    df = spark.range(9248).select(F.col("id").alias("k"), (F.col("id") % 10).alias("label"),
                                  F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("language"))
    s = smp.stratified_split(df, ["label", "language"], "k")
    assert s.where(F.col("split") == "val").count() == 2775
    assert s.where(F.col("split") == "train").count() == 6473
