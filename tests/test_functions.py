"""Edge cases of the column functions (FIXTURES.md section 4)."""

import json


from labelforge import spec
from labelforge.functions import labels as lab
from labelforge.functions import text as tx
from labelforge.functions import vectors as vec


def test_crosswalk_edges(spark):
    df = spark.createDataFrame([("Hate",), ("WORRY",), ("surprise",), (" anger",), (None,)], "s string")
    out = [r[0] for r in df.select(lab.crosswalk("s")).collect()]
    assert out == ["Anger", "Fear", None, None, None]


def test_crosswalk_guard():
    import pytest
    with pytest.raises(ValueError):
        spec.target_of_source({"Surprise": ["surprise"]}, spec.TARGET_LABELS)


def test_crosswalk_source_under_two_targets():
    import pytest
    with pytest.raises(ValueError):
        spec.target_of_source({"Joy": ["fun"], "Fear": ["Fun"]}, spec.TARGET_LABELS)


def _scores(spark, rows, schema=None):
    cols = list(spec.SCORE_COLUMNS)
    schema = schema or ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema)


def test_dominant_label_neutral_cases(spark):
    rows = [(0.0,) * 6, (None,) * 6, (-1.0,) * 6, (float("nan"),) * 6]
    out = lab.dominant_label(_scores(spark, rows)).select("emotion").collect()
    assert [r[0] for r in out] == ["Neutral"] * 4


def test_dominant_label_all_strings_is_neutral(spark):
    schema = ", ".join(f"{c} string" for c in spec.SCORE_COLUMNS)
    df = spark.createDataFrame([("a",) * 6], schema)
    assert lab.dominant_label(df).first()["emotion"] == "Neutral"


def test_dominant_label_ties(spark):
    rows = [(0.5, 0.0, 0.0, 0.5, 0.0, 0.0),   # anger .5, fear .5 -> Anger
            (0.9, 0.1, 0.0, 0.0, 0.9, 0.0),   # love .9 (Joy), anger .9 -> Anger
            (0.1, 0.2, 0.0, 0.0, 0.0, 0.7)]   # thankfulness -> Joy
    out = [r[0] for r in lab.dominant_label(_scores(spark, rows)).select("emotion").collect()]
    assert out == ["Anger", "Anger", "Joy"]


def test_dominant_label_without_neutral(spark):
    targets = ["Anger", "Joy", "Sadness", "Fear"]
    df = _scores(spark, [(0.0,) * 6, (0.0, 0.0, 0.3, 0.0, 0.0, 0.0)])
    out = [r[0] for r in lab.dominant_label(df, targets=targets).select("emotion").collect()]
    assert out == ["Anger", "Sadness"]


def test_encode_decode(spark):
    df = spark.createDataFrame([("Anger",), ("Fear",), ("joy",), (None,)], "s string")
    assert [r[0] for r in df.select(lab.encode_label("s")).collect()] == [0, 4, None, None]
    df2 = spark.createDataFrame([(0,), (4,), (7,)], "i int")
    assert [r[0] for r in df2.select(lab.decode_label("i")).collect()] == ["Anger", "Fear", "Label_7"]


def test_validate_answer(spark):
    answers = ['{"emotion":"Joy"}', '{"emotion":"joy"}', '{"mood":"Joy"}', "[]",
               "Joy", '["emotion"]', "5", '{"emotion": 5}']
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    out = df.select(lab.validate_answer("a").alias("v")).select("v.*").collect()
    got = [(r["emotion"], r["success"], r["error"] is not None) for r in out]
    assert got == [("Joy", True, False), ("Anger", True, False), ("Anger", True, False),
                   ("Anger", True, False), ("Anger", False, True), ("Anger", False, True),
                   ("Anger", False, True), ("Anger", True, False)]


def test_strip_is_unicode(spark):
    df = spark.createDataFrame([(" \n\t x y 　\r\n",)], "s string")
    assert df.select(tx.py_strip("s")).first()[0] == "x y"


def _clean(spark, messages):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "id int, message string")
    out = tx.clean_mail(df).orderBy("id").collect()
    return [r["preprocessed_text"] for r in out]


def test_mail_edges(spark):
    header = "Message-ID: <1>\nX-FileName: a.nsf\n\n"
    msgs = [
        None,                                                   # null -> ''
        header,                                                 # header with empty body -> ''
        header + "Hi\n--- Forwarded by Bob ---\nold",           # forwarded -> ''
        "plain text\n\n\n\nSent from my phone",                 # no marker: footer cut, stripped
        "X-FileName: b\nskip\n  body line  \n",                 # line fallback
        "X-FileName: only",                                     # marker, no lines after -> unchanged
        header + "New text\n\nJane\n01/02/2001 10:11 AM\nTo: b\nx\nTo: c\nold thread",  # reply cut
        header + "Body\n\n\n\nP.S. more",                       # newline runs collapse
    ]
    assert _clean(spark, msgs) == ["", "", "", "plain text", "body line", "X-FileName: only",
                                   "New text", "Body\n\nP.S. more"]


def test_footer_order_matters(spark):
    header = "X-FileName: a\n\n"
    # the disclaimer needs both parts inside the text left by earlier patterns
    # (the confidentiality pattern runs first and removes "intended solely for")
    msg = header + "Hello\nThis message CONFIDENTIALITY NOTICE\nintended solely for you"
    assert _clean(spark, [msg]) == ["Hello\nThis message"]


def test_prefixes():
    assert spec.prefix_for("query") == "query: "
    assert spec.prefix_for("none") is None
    assert spec.instruct_prefix().endswith("Anger, Neutral, Joy, Sadness, Fear.\nQuery: ")
    assert "text message" in spec.instruct_prefix(spec.INSTRUCT_MEDIUM_THROUGHPUT)


def test_prefix_keeps_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    out = [r[0] for r in df.select(tx.with_prefix("t", "passage")).collect()]
    assert out == ["passage: a", None]


def test_safe_name(spark):
    df = spark.createDataFrame([("intfloat/e5:large Ü-1_x",)], "s string")
    r = df.select(tx.safe_name("s"), tx.model_path_name("s")).first()
    assert r[0] == "intfloat_e5_large_Ü-1_x"
    assert r[1] == "intfloat/e5_large Ü-1_x"


def test_fixed_decimals(spark):
    df = spark.createDataFrame([(1.0,), (0.12344,), (-2.5,), (None,), (1024.0,)], "x double")
    out = [r[0] for r in df.select(tx.fixed_decimals("x", 2)).collect()]
    assert out == ["1.00", "0.12", "-2.50", None, "1024.00"]


def test_fixed_decimals_equal_python_formatting(spark):
    import random
    rng = random.Random(7)
    values = [1.115, 2.675, 0.125, 0.375, 0.5, 0.995, 0.9999999, -0.001, -0.0, 1e17, 2.0 ** 52 + 0.5, 2.0 ** 62,
              4503599627370495.5, 1e-300, 5e-324, float("nan"), float("inf"), float("-inf")]
    values += [rng.randrange(10 ** 7) / 8 * 10 ** rng.randrange(-6, 3) for _ in range(500)]
    values += [rng.uniform(-1e4, 1e4) for _ in range(500)] + [k / 1000 for k in range(-300, 300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (2, 4):
        out = [r[0] for r in df.select(tx.fixed_decimals("x", digits)).collect()]
        assert out == [f"{v:.{digits}f}" for v in values]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 4.0],)], "v array<double>")
    r = df.select(vec.argmax("v"), vec.l2_norm("v"), vec.l2_normalize("v"), vec.log_sum_exp("v")).first()
    assert r[0] == 1
    assert abs(r[1] - (41 ** 0.5)) < 1e-12
    assert abs(sum(x * x for x in r[2]) - 1.0) < 1e-12
    import math
    assert abs(r[3] - math.log(math.exp(3) + 2 * math.exp(4))) < 1e-12


def test_annotate_system_prompt_lists_labels():
    p = spec.annotate_system_prompt()
    for label in spec.TARGET_LABELS:
        assert f"* {label}" in p
    json.dumps(p)


def test_quoted_header_removed(spark):
    block = ('"Jane Doe" <jane.doe@x.com> on 01/02/2001 10:11:12 AM To: Bob\nCc: x\nSubject: Re: hi\n')
    df = spark.createDataFrame([("keep " + block + "after",), ("no header here",)], "t string")
    out = [r[0] for r in df.select(tx.remove_quoted_headers("t")).collect()]
    # the name class has no space, so the match starts at the last name word
    assert out == ["keep \"Jane after", "no header here"]
