"""The rows that the language model learns from."""

from pyspark.sql import functions as F

from labelforge.llm import language

SCHEMA = "doc_id long, text string, lang string"


def test_rare_languages_are_drawn_and_learned(spark):
    common = [(i, f"the weather of the day number {i} is good", "en") for i in range(3000)]
    rare = [(10_000 + i, f"das wetter am tag {i} ist schön und warm", "de") for i in range(6)]
    docs = spark.createDataFrame(common + rare, SCHEMA)
    rows = language.drawn(docs, max_rows=60, per_lang=50).collect()
    assert len(rows) == 56 and sum(r.lang == "de" for r in rows) == 6
    model = language.train(docs, max_rows=60, per_lang=50)
    assert model.names == ["de", "en"]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert all(got[k] == lang for k, _, lang in rare)


def test_repeated_ids_are_drawn_once(spark):
    docs = spark.createDataFrame([(1, "one", "en")] * 500 + [(1, "uno", "es"), (2, "zwei", "de"), (3, None, "fr")], SCHEMA)
    rows = sorted(tuple(r) for r in language.drawn(docs.where("text is not null"), 10, 10).collect())
    assert rows == [(1, "one", "en"), (2, "zwei", "de")]


def test_draw_is_bounded_and_reruns_agree(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"),
                                    F.concat(F.lit("l"), (F.col("id") % 7).cast("string")).alias("lang"))
    first = {r.doc_id for r in language.drawn(docs, 100, 1000).collect()}
    assert len(first) == 100
    assert first == {r.doc_id for r in language.drawn(docs.repartition(9), 100, 1000).collect()}
    assert language.drawn(docs.limit(0), 100, 1000).count() == 0


def test_draw_takes_the_lowest_hashes_of_each_language(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"),
                                      F.when(F.col("id") % 40 == 0, "de").otherwise("en").alias("lang"))
    got = {(r.doc_id, r.lang) for r in language.drawn(docs, 1000, 300).collect()}
    rows = sorted((r.h, r.doc_id, r.lang) for r in docs.withColumn("h", F.xxhash64("doc_id")).collect())
    want = set()
    for lang in ("de", "en"):
        want |= {(k, lang) for _, k, x in [r for r in rows if r[2] == lang][:300]}
    assert got == want
