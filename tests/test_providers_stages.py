"""Dataset providers, stage manifests, ids of the fused posts, counts of the timed
encoder job, Unicode classes of the mail patterns."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.functions import text as tx
from labelforge.operators import embed as emb
from labelforge.operators import events as evt
from labelforge.plans import datasets
from labelforge.sources import files as fio
from labelforge.sources import providers, views
from tests.conftest import SF


def folder(name):
    return tempfile.mkdtemp(prefix="lf-stage-") + "/" + name


@pytest.fixture()
def stage(spark):
    source, path, built = folder("input"), folder("stage"), []
    spark.createDataFrame([("a", "en"), ("b", "de")], "text string, language string").write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source)

    def ask(cols=("text",), predicate=None, **settings):
        n = len(built)
        out = fio.ensure_stage(spark, path, build, list(cols), predicate, [source], settings)
        return len(built) > n, out.count()

    return source, path, ask


def test_valid_stage_is_reused(stage):
    _, _, ask = stage
    assert ask() == (True, 2)
    assert ask() == (False, 2)
    assert ask(predicate=F.col("language") == "en") == (False, 2)


def test_stage_without_manifest_is_rebuilt(spark, stage):
    _, path, ask = stage
    ask()
    spark.createDataFrame([("a", "en")], "text string, language string").write.mode("overwrite").parquet(path)
    assert ask() == (True, 2)


def test_stage_with_other_rows_than_its_manifest_is_rebuilt(spark, stage):
    _, path, ask = stage
    ask()
    spark.createDataFrame([("late", "en")], "text string, language string").write.mode("append").parquet(path)
    assert ask() == (True, 2)


def test_stage_is_rebuilt_for_changed_input_settings_and_columns(spark, stage):
    source, _, ask = stage
    ask()
    spark.createDataFrame([("c", "fr")], "text string, language string").write.mode("append").parquet(source)
    assert ask() == (True, 3)
    assert ask() == (False, 3)
    assert ask(attempts=5) == (True, 3)
    assert ask(attempts=5) == (False, 3)
    assert ask(cols=["text", "missing"], attempts=5) == (True, 3)
    assert ask(predicate=F.col("language") == "es", attempts=5) == (True, 3)


def test_empty_stage_is_never_valid(spark):
    path, built = folder("stage"), []

    def build():
        built.append(1)
        return spark.createDataFrame([], "text string")

    for _ in range(2):
        assert fio.ensure_stage(spark, path, build, ["text"]).count() == 0
    assert len(built) == 2


def test_fingerprint_ignores_the_manifest(spark, stage):
    _, path, ask = stage
    ask()
    before = fio.input_fingerprint(spark, [path])
    assert before.startswith(f"{len(spark.read.parquet(path).inputFiles())}:")
    assert fio.input_fingerprint(spark, []) == ""


def test_provider_takes_the_first_text_column(spark):
    def load(spark, sf):
        return spark.createDataFrame([(1, "s", "x")], "id long, sentence string, label string")

    p = providers.DatasetProvider("p", load, (), ("id",), ("label",))
    df = providers.open_dataset(p, spark, SF)
    assert df.columns == ["id", "text", "label"] and df.first()["text"] == "s"


def test_provider_names_what_is_missing(spark):
    def load(spark, sf):
        return spark.createDataFrame([(1, "s")], "id long, body string")

    with pytest.raises(ValueError, match="text"):
        providers.open_dataset(providers.DatasetProvider("p", load, (), ("id",)), spark, SF)
    with pytest.raises(ValueError, match="label"):
        providers.open_dataset(providers.DatasetProvider("p", load, (), ("id",), ("label",), ("body",)), spark, SF)


def test_provider_keeps_the_first_of_equal_names(spark):
    def load(spark, sf):
        df = spark.createDataFrame([(1, "one")], "id long, text string")
        return df.join(spark.createDataFrame([(1, "two")], "key long, text string"), F.col("id") == F.col("key"))

    assert providers.open_dataset(providers.DatasetProvider("p", load, (), ("id",)), spark, SF).first()["text"] == "one"


def test_providers_open_on_the_tables(spark):
    for p in (providers.POSTS, providers.SCORED_TURNS, providers.MAILS):
        df = providers.open_dataset(p, spark, SF)
        assert df.columns == [*p.key_cols, "text", *p.label_cols] and not df.isEmpty()


def test_fused_ids_never_meet(spark, monkeypatch):
    big = 2 ** 63 - 1
    posts = [(i, "t", "en", "s", "anger") for i in (0, 1, 2, big, big - 1)]
    turns = [(c, t, "t", *[1.0] * len(spec.SCORE_COLUMNS)) for c, t in
             ((0, 0), (0, 1), (0, 1000), (1, 0), (big, 0), (big, 2 ** 31 - 1))]
    frames = {
        "posts": spark.createDataFrame(posts, "doc_id long, text string, lang string, source string, sentiment string"),
        "turns": spark.createDataFrame(turns, "conv_id long, turn int, text string, "
                                       + ", ".join(f"{c} double" for c in spec.SCORE_COLUMNS))}
    monkeypatch.setattr(datasets, "POSTS", providers.DatasetProvider("p", lambda *_: frames["posts"], (), ("doc_id",), ("sentiment",)))
    monkeypatch.setattr(datasets, "SCORED_TURNS", providers.DatasetProvider(
        "t", lambda *_: frames["turns"], (), ("conv_id", "turn"), tuple(spec.SCORE_COLUMNS)))
    ids = [r["item_id"] for r in datasets.fused_posts(spark, SF).collect()]
    assert None not in ids and len(set(ids)) == len(ids) == len(posts) + len(turns)


def test_throughput_counts_in_the_timed_job(spark):
    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "text string")
    row = emb.encode_throughput(spark, df, "text", "m", warmup_rows=1).first()
    assert (row["num_sentences_processed"], row["num_failed"], row["error"]) == (3, 0, None)


def test_throughput_of_no_texts(spark):
    row = emb.encode_throughput(spark, spark.createDataFrame([], "text string"), "text", "m").first()
    assert (row["num_sentences_processed"], row["num_failed"], row["error"]) == (0, 0, None)


def test_performance_facts_edges(spark):
    rows = [(10, 4.0, 100.004, 150.126), (10, 0.004, 1.0, 2.0), (None, 2.0, None, 2.0), (10, None, 1.0, None),
            (7, 2.675, 0.0, 0.125)]
    df = spark.createDataFrame(rows, "num_sentences_processed long, inference_time_s double, ram_before_load_mb double, ram_after_load_mb double")
    got = [(r["sentences_per_second"], r["model_ram_footprint_mb"]) for r in evt.performance_facts(df).collect()]
    assert got == [(2.5, 50.13), (0.0, 1.0), (None, None), (None, None),
                   (round(7 / round(2.675, 2), 2), round(round(0.125, 2) - 0.0, 2))]


def test_performance_facts_equal_python(spark):
    df = views.performance_records(spark, SF)
    for r in evt.performance_facts(df).collect():
        t = round(r["inference_time_s"], 2)
        assert r["sentences_per_second"] == (round(r["num_sentences_processed"] / t, 2) if t > 0 else 0.0)
        assert r["model_ram_footprint_mb"] == round(round(r["ram_after_load_mb"], 2) - round(r["ram_before_load_mb"], 2), 2)


def test_mail_patterns_take_unicode_spaces_and_digits(spark):
    nbsp, wide, arabic = " ", "　", "١"
    mails = [f"body\n\n--{nbsp}Forwarded by X ---", f"one\n\nJane\n0{arabic}/02/2001{wide}10:11 AM{nbsp}To: b\nTo: c",
             f"keep\n__________{nbsp}Do You Yahoo!? more", "plain\x85text"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(mails)], "i int, m string")
    got = [r[0] for r in df.orderBy("i").select(tx.split_conversation("m")).collect()]

    def split(m):
        if re.search(spec.FORWARDED_PATTERN, m, re.S):
            return ""
        if re.search(spec.MULTIPLE_TO_PATTERN, m, re.S | re.I) and (hit := re.search(spec.REPLIED_PATTERN, m, re.S | re.I)):
            return m[:hit.start()].strip()
        return m

    assert got == [split(m) for m in mails] == ["", "one", mails[2], mails[3]]
    for pattern in spec.FOOTER_PATTERNS:
        hits = [r[0] for r in df.orderBy("i").select(tx.footer_hit("m", pattern)).collect()]
        assert hits == [re.search(pattern, m, re.S) is not None for m in mails], pattern


def test_unicode_classes_inside_and_outside_a_class():
    assert tx.unicode_classes(r"\d[\d.]\.") == r"[\p{Nd}][\p{Nd}.]\."


def test_centroid_scores_equal_plain_cosines(spark):
    from labelforge.operators import model as mdl
    schema = "i int, e array<float>, label int"
    train = spark.createDataFrame([(0, [1.0, 0.0, 2.0], 1), (1, [3.0, 0.0, 0.0], 1), (2, [0.0, 1.0, 0.0], 4)], schema)
    odd = [(0, [1.0, 2.0, 3.0], 0), (1, None, 0), (2, [1.0, None, 0.0], 0), (3, [1.0], 0), (4, [0.0, 0.0, 0.0], 0), (5, [], 0),
           (6, [-1.0, 0.5, 0.0], 0)]
    cents = mdl.centroids(train, "e", "label")
    got = {r["i"]: r["s"] for r in mdl.centroid_scores(spark.createDataFrame(odd, schema), cents, "e", "s").collect()}
    means, best = [[2.0, 0.0, 1.0], [0.0, 1.0, 0.0]], {}
    for i, v, _ in odd:
        if v is None or len(v) != 3 or None in v:
            assert got[i] is None
            best[i] = None
            continue
        norm = max(sum(x * x for x in v) ** 0.5, 1e-12)
        want = [sum(x * y for x, y in zip(v, m)) / (norm * sum(y * y for y in m) ** 0.5) for m in means]
        assert got[i] == pytest.approx(want, abs=1e-12)
        best[i] = [1, 4][want.index(max(want))]
    pred = {r["i"]: r["pred_label"] for r in mdl.centroid_predict(spark.createDataFrame(odd, schema), cents, "e").collect()}
    assert pred == best


def test_centroid_scores_without_classes(spark):
    from labelforge.operators import model as mdl
    none = spark.createDataFrame([], "e array<float>, label int")
    rows = spark.createDataFrame([([1.0],)], "e array<float>")
    assert mdl.centroid_predict(rows, mdl.centroids(none, "e", "label"), "e").first()["pred_label"] is None


def test_profile_notes_at_the_limits(spark):
    rows = [(1, "inference_run", 300.0, 0.1), (2, "inference_run", 300.005, 1.0), (3, "inference_run", 5000.125, float("nan")),
            (4, "inference_run", None, 0.1), (5, "model_load", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "event_id int, event_type string, ram_usage_delta_mb double, seconds_per_text double")
    got = {(r["event_id"], r["profile"]): (r["status"], r["notes"]) for r in evt.pc_compatibility(df).collect()}
    assert (4, None) in got and len(got) == 10
    for event_id, kind, ram, spt in rows[:3]:
        for name, max_ram, max_time in spec.PC_PROFILES:
            notes = []
            if not ram <= max_ram:
                notes.append(f"May struggle on {name} due to RAM usage (needs {ram:.2f}MB delta, profile target <{max_ram:.2f}MB).")
            if not spt <= max_time:
                notes.append(f"May be too slow for {name} (takes {spt:.4f}s/email, profile target <{max_time:.2f}s).")
            want = ("not compatible", " ".join(notes)) if notes else ("compatible", f"Likely compatible with: {name}")
            assert got[event_id, name] == want
