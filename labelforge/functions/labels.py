"""Label column functions: encode/decode, crosswalk, dominant label, answer check.

Lookups against the small configured tables are literal ``map`` expressions,
so they need neither a join nor a broadcast and stay inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge import spec
from labelforge.functions.text import col_


def _literal_map(pairs: dict) -> Column:
    args = []
    for k, v in pairs.items():
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


# -- P9 / P10 -----------------------------------------------------------------

def encode_label(c, labels=spec.TARGET_LABELS) -> Column:
    """Label name -> index; unknown or null -> null (case-sensitive)."""
    return F.try_element_at(_literal_map(spec.label_index(labels)), col_(c))


def decode_label(c, labels=spec.TARGET_LABELS) -> Column:
    """Index -> name, ``Label_<i>`` when the index is outside the taxonomy."""
    c = col_(c)
    names = F.array(*[F.lit(x) for x in labels])
    return F.coalesce(F.get(names, c.cast("int")), F.concat(F.lit("Label_"), c.cast("string")))


# -- P11: crosswalk ---------------------------------------------------------------

def crosswalk(c, mapping=spec.POST_CROSSWALK, targets=spec.TARGET_LABELS) -> Column:
    """Many-to-one map on the lower-cased source label; unmapped -> null."""
    reverse = spec.target_of_source(mapping, targets)
    return F.try_element_at(_literal_map(reverse), F.lower(col_(c)))


# -- P13: dominant label from score columns ---------------------------------------

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def _clamped(c: Column) -> Column:
    x = c.cast("double")
    return F.greatest(F.lit(0.0), F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))


def dominant_label(df: DataFrame, out_col: str = "emotion",
                   score_columns=spec.SCORE_COLUMNS, targets=spec.TARGET_LABELS) -> DataFrame:
    """Add ``out_col``: the target with the largest clamped score.

    Per target the score is the max over its mapped numeric columns of
    ``max(0, value)`` (null/NaN count as 0; non-numeric columns are skipped).
    A maximum <= 0 gives ``Neutral`` when it is a target; otherwise the first
    mapped target.  Ties go to the alphabetically first target.  Rows with no
    numeric score at all are dropped when ``Neutral`` is not a target.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    mapping = {c: t for c, t in score_columns.items() if t in targets}
    found = [c for c in mapping if c in types and isinstance(types[c], _NUMERIC)]
    per_target: dict[str, list[str]] = {}
    for c in found:
        per_target.setdefault(mapping[c], []).append(c)
    has_neutral = "Neutral" in targets
    if not per_target:
        if has_neutral:
            return df.withColumn(out_col, F.lit("Neutral"))
        return df.where(F.lit(False)).withColumn(out_col, F.lit(None).cast("string"))
    scores = {t: F.greatest(*[_clamped(F.col(c)) for c in cols]) if len(cols) > 1
              else _clamped(F.col(cols[0])) for t, cols in per_target.items()}
    names = list(scores)
    top = F.greatest(*scores.values()) if len(scores) > 1 else scores[names[0]]
    pick = None
    for t in sorted(names):
        cond = scores[t] == F.col("_lf_top")
        pick = F.when(cond, F.lit(t)) if pick is None else pick.when(cond, F.lit(t))
    zero_label = "Neutral" if has_neutral else names[0]
    out = df.withColumn("_lf_top", top).withColumn(
        out_col, F.when(F.col("_lf_top") <= 0, F.lit(zero_label)).otherwise(pick))
    return out.drop("_lf_top")


# -- X10: validate a model answer --------------------------------------------------

def validate_answer(c, targets=spec.TARGET_LABELS) -> Column:
    """Parse a JSON answer and return ``struct(emotion, success, error)``.

    * object with key ``emotion`` whose value is a configured target
      (case-sensitive) -> that target, success;
    * any other object, or an array/string that does not contain ``emotion``
      -> first target (fallback), success;
    * not JSON, a number/bool/null, or an array/string containing
      ``emotion`` -> first target, failure with an error text.
    """
    raw = col_(c)
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    value = F.try_variant_get(v, "$.emotion", "string")
    as_list = F.try_variant_get(v, "$", "array<string>")
    as_text = F.try_variant_get(v, "$", "string")
    fallback = F.lit(targets[0])
    is_obj = kind.startswith("OBJECT")
    is_arr = kind.startswith("ARRAY")
    is_str = kind == "STRING"
    ok_value = is_obj & value.isNotNull() & value.isin(*targets)
    soft = is_obj | (is_arr & ~F.coalesce(F.array_contains(as_list, "emotion"), F.lit(False))) \
        | (is_str & ~as_text.contains("emotion"))
    error = (
        F.when(raw.isNull(), F.lit("no answer"))
        .when(v.isNull(), F.lit("answer is not valid JSON"))
        .otherwise(F.lit("answer has no usable 'emotion' key"))
    )
    return (
        F.when(ok_value, F.struct(value.alias("emotion"), F.lit(True).alias("success"),
                                   F.lit(None).cast("string").alias("error")))
        .when(v.isNotNull() & soft,
              F.struct(fallback.alias("emotion"), F.lit(True).alias("success"),
                       F.lit(None).cast("string").alias("error")))
        .otherwise(F.struct(fallback.alias("emotion"), F.lit(False).alias("success"),
                            error.alias("error")))
    )
