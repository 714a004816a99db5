"""Repeated annotation (M1), majority vote (A4-A7) and translation (M2).

The model clients are injected.  They run inside ``mapInArrow`` on the
executors, a small slice of an Arrow batch at a time, so a task's Python holds
the answers of a slice and no more; parallelism is bounded by the number of
partitions (repartition the input to cap concurrent calls).  Each email row
carries all its attempts as an array, so validation and the vote are
higher-order column expressions on that row: no shuffle at all.

Results of paid calls must be materialised before they are used twice
(``materialize``): a retried or repeated action would otherwise call the
service again and, with a non-deterministic client, change the answers.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge import spec
from labelforge.functions.labels import validate_answer
from labelforge.operators.partitioning import spread, text_slices

# A client answers one prompt: (row key, attempt number, system prompt, prompt)
# -> text.  It raises on failure.
AnswerClient = Callable[[object, int, str, str], str]
# A translation client: (row key, text, system prompt, prompt with the text) ->
# translated text; raises on failure.
TranslateClient = Callable[[object, str, str, str], str]
# System prompt and prompt of a translation.
MAIL_PROMPTS = (spec.TRANSLATE_MAIL_SYSTEM_PROMPT, spec.TRANSLATE_MAIL_USER_PROMPT)
POST_PROMPTS = (spec.TRANSLATE_POST_SYSTEM_PROMPT, spec.TRANSLATE_POST_USER_PROMPT)


# -- stand-in clients (offline, deterministic) -------------------------------------

def stub_hash(key, attempt: int) -> int:
    digest = hashlib.md5(f"{key}#{attempt}".encode()).hexdigest()
    return int(digest[:7], 16)


def stub_answer_client(key, attempt: int, system: str, prompt: str, labels=spec.TARGET_LABELS) -> str:
    """Hash bucket of (key, attempt): 0-6 a valid answer, 7 an unknown label,
    8 JSON without the key, 9 not JSON."""
    h = stub_hash(key, attempt)
    r = h % 10
    if r <= 6:
        return '{"emotion": "%s"}' % labels[h % len(labels)]
    if r == 7:
        return '{"emotion": "Surprise"}'
    if r == 8:
        return '{"mood": "Joy"}'
    return "no idea"


class StubTranslationError(RuntimeError):
    pass


def stub_translate_client(key, text: str, system: str, prompt: str) -> str:
    """``de:`` + text; fails for keys divisible by 13."""
    if int(key) % 13 == 0:
        raise StubTranslationError("translation service unavailable")
    return "de:" + text


# -- M1: annotation ----------------------------------------------------------------

RAW_ATTEMPT = T.StructType([
    T.StructField("attempt_id", T.IntegerType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("elapsed_time", T.DoubleType()),
    T.StructField("call_error", T.StringType()),
])
RAW_TYPES = {"attempt_id": pa.int32(), "raw_response": pa.string(), "elapsed_time": pa.float64(), "call_error": pa.string()}
TRANSLATION_TYPES = {"translated_text": pa.string(), "success": pa.bool_(), "elapsed_time": pa.float64(),
                     "raw_response": pa.string(), "error": pa.string()}


def _sliced(batches: Iterator[pa.RecordBatch], key_col: str, text_col: str) -> Iterator[tuple[list, pa.RecordBatch]]:
    """(keys, slice) of the batches.  Keys are those of pandas over the whole batch."""
    for batch in batches:
        keys = batch[key_col].to_pandas(date_as_object=True).tolist()
        for at, part in text_slices(batch, text_col):
            yield keys[at:at + part.num_rows], part


def annotate(df: DataFrame, key_col: str, text_col: str, client: AnswerClient = stub_answer_client,
             attempts: int = spec.NUM_ATTEMPTS, labels=spec.TARGET_LABELS,
             timed: bool = False) -> DataFrame:
    """Call ``client`` ``attempts`` times per row; the prompt is put together in
    the task, so the text is sent there once.

    Returns the input columns plus ``attempts``: ARRAY<STRUCT<attempt_id,
    emotion, success, elapsed_time, raw_response, error>> in attempt order.
    """
    system = spec.annotate_system_prompt(labels)
    user = spec.annotate_user_prompt(labels)
    out_schema = T.StructType(list(df.schema.fields)
                              + [T.StructField("_lf_raw", T.ArrayType(RAW_ATTEMPT))])

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, part in _sliced(batches, key_col, text_col):
            made = {name: [] for name in RAW_TYPES}
            for key, text in zip(keys, part[text_col].to_pylist()):
                prompt = user.replace("{text}", text if isinstance(text, str) else "")
                for a in range(attempts):
                    start = time.perf_counter()
                    try:
                        answer = client(key, a, system, prompt)
                        answer = answer.strip() if isinstance(answer, str) else answer
                        err = None
                    except Exception as exc:  # a failed call is data, not a task failure
                        answer, err = None, f"{type(exc).__name__}: {exc}"
                    elapsed = time.perf_counter() - start if timed else 0.0
                    for name, v in zip(made, (a, answer, float(elapsed), err)):
                        made[name].append(v)
            rows = pa.StructArray.from_arrays([pa.array(made[n], t) for n, t in RAW_TYPES.items()], list(RAW_TYPES))
            ends = pa.array(range(0, len(keys) * attempts + 1, attempts) if attempts else [0] * (len(keys) + 1), pa.int32())
            yield part.append_column("_lf_raw", pa.ListArray.from_arrays(ends, rows))

    raw = spread(df).mapInArrow(call, out_schema)

    def checked(a: Column) -> Column:
        v = validate_answer(a["raw_response"], labels)
        failed_call = a["call_error"].isNotNull()
        return F.struct(
            a["attempt_id"].alias("attempt_id"),
            F.when(failed_call, F.lit(labels[0])).otherwise(v["emotion"]).alias("emotion"),
            F.when(failed_call, F.lit(False)).otherwise(v["success"]).alias("success"),
            a["elapsed_time"].alias("elapsed_time"),
            F.when(failed_call | ~v["success"], F.lit(None).cast("string"))
            .otherwise(a["raw_response"]).alias("raw_response"),
            F.coalesce(a["call_error"], v["error"]).alias("error"),
        )

    return raw.select(*df.columns, F.transform("_lf_raw", checked).alias("attempts"))


def attempts_long(annotated: DataFrame, key_col: str) -> DataFrame:
    """One row per attempt (``email_id, attempt_id, emotion, ...``)."""
    return annotated.select(key_col, F.explode("attempts").alias("a")).select(key_col, "a.*")


# -- A4-A7: vote --------------------------------------------------------------------

def vote(annotated: DataFrame, key_col: str, attempts: int = spec.NUM_ATTEMPTS) -> DataFrame:
    """Majority label per row; ties go to the label seen first by attempt order.

    confidence = majority count / configured number of attempts;
    emotion_counts = JSON object label -> count with sorted keys;
    emotion_attempt_<i> = label of attempt i-1 (null when absent).
    """
    ordered = F.array_sort(F.col("attempts"), lambda l, r: (l["attempt_id"] - r["attempt_id"]).cast("int"))
    labels = F.transform(ordered, lambda a: a["emotion"])
    distinct = F.array_distinct(labels)  # first-seen order
    tally = F.transform(distinct, lambda x: F.struct(
        x.alias("label"), F.size(F.filter(labels, lambda y: y == x)).alias("n")))
    top_n = F.array_max(F.transform(tally, lambda s: s["n"]))
    winner = F.get(F.filter(tally, lambda s: s["n"] == top_n), 0)["label"]
    counts_json = F.to_json(F.map_from_entries(F.array_sort(tally)))

    def attempt(i: int) -> Column:
        return F.get(F.filter("attempts", lambda a: a["attempt_id"] == i), 0)["emotion"]

    wide = [attempt(i).alias(f"emotion_attempt_{i + 1}") for i in range(attempts)]
    keep = [c for c in annotated.columns if c != "attempts"]
    return annotated.select(
        *keep,
        winner.alias("emotion"),
        (top_n / F.lit(float(attempts))).alias("confidence"),
        counts_json.alias("emotion_counts"),
        *wide,
    )


# -- M2: translation ---------------------------------------------------------------

def translate(df: DataFrame, key_col: str, text_col: str,
              client: TranslateClient = stub_translate_client, timed: bool = False,
              prompts: tuple[str, str] = MAIL_PROMPTS) -> DataFrame:
    """Add ``translated_text, success, elapsed_time, raw_response, error``.

    Input columns pass through unchanged (no join back).  Blank or null text
    is not sent: ``[EMPTY_TEXT]``, success.  A failed call gives
    ``[TRANSLATION_FAILED]``, no success, and the error text.
    """
    added = [f for f in spec.TRANSLATION_FIELDS.fields if f.name not in df.columns]
    out_schema = T.StructType(list(df.schema.fields) + added)
    names = [f.name for f in added]
    system, user = prompts

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, part in _sliced(batches, key_col, text_col):
            out = {name: [] for name in TRANSLATION_TYPES}
            for key, text in zip(keys, part[text_col].to_pylist()):
                if not isinstance(text, str) or not text.strip():
                    vals = (spec.EMPTY_TEXT, True, 0.0, "", None)
                else:
                    start = time.perf_counter()
                    try:
                        answer = client(key, text, system, user.replace("{text}", text))
                        elapsed = time.perf_counter() - start if timed else 0.0
                        vals = (answer.strip(), True, float(elapsed), answer, None)
                    except Exception as exc:
                        elapsed = time.perf_counter() - start if timed else 0.0
                        vals = (spec.TRANSLATION_FAILED, False, float(elapsed), None, str(exc))
                for name, v in zip(out, vals):
                    out[name].append(v)
            for name in names:
                part = part.append_column(name, pa.array(out[name], TRANSLATION_TYPES[name]))
            yield part

    return spread(df).mapInArrow(call, out_schema)


def materialize(df: DataFrame) -> DataFrame:
    """Write the result to the shared checkpoint folder and cut the lineage."""
    return df.checkpoint(eager=True)
