"""Python memory of annotation and translation tasks."""

import tracemalloc

from pyspark.sql import functions as F

from labelforge.operators import annotate as ann


def _holding():
    def held(key):
        """Bytes that the worker's Python holds, told by every hundredth row as an error."""
        if not tracemalloc.is_tracing():
            tracemalloc.start()
        if int(key) % 100 == 99:
            raise RuntimeError(str(tracemalloc.get_traced_memory()[0]))
    return held


def _most(errors) -> int:
    return max(int(e.rsplit(" ", 1)[-1]) for e in errors)


def test_annotation_holds_the_answers_of_a_slice(spark):
    held = _holding()

    def client(key, attempt, system, prompt):
        held(key)
        return "y" * 5000 + str(key)

    df = spark.range(16000).select(F.col("id").alias("k"), F.lit("text").alias("t"))   # 4,000 rows a task
    a = ann.attempts_long(ann.annotate(df, "k", "t", client, attempts=1), "k")
    found = a.select("error").where(F.col("error").startswith("RuntimeError")).collect()
    assert len(found) == 160 and _most(r["error"] for r in found) < 12 << 20


def test_translation_holds_the_answers_of_a_slice(spark):
    held = _holding()

    def client(key, text, system, prompt):
        held(key)
        return "y" * 5000 + str(key)

    df = spark.range(16000).select(F.col("id").alias("k"), F.lit("text").alias("t"))
    found = ann.translate(df, "k", "t", client).where("not success").select("error").collect()
    assert len(found) == 160 and _most(r["error"] for r in found) < 12 << 20


def test_slices_keep_every_row_in_order(spark):
    rows = [(i, None if i % 7 == 0 else "x" * (i % 5 * 1_000_000), f"p{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, t string, p string").coalesce(1)
    got = ann.annotate(df, "k", "t", lambda key, a, s, p: f"{key}-{a}-{len(p)}", attempts=2)
    raw = {r["k"]: r for r in got.collect()}
    assert [raw[k]["t"] for k, _, _ in rows] == [t for _, t, _ in rows] and [raw[k]["p"] for k, _, _ in rows] == [p for *_, p in rows]
    assert all([a["attempt_id"] for a in r["attempts"]] == [0, 1] for r in raw.values())
