"""Monitoring events.

Event derivations are column arithmetic.  The hardware check pairs every
inference event with the three configured profiles by exploding a literal
array of profile structs: no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge import spec
from labelforge.functions.text import fixed_decimals


def text_volume(df: DataFrame, text_col: str, group_cols=()) -> DataFrame:
    """Number of texts, total characters and the average per text."""
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("num_texts"),
        F.sum(F.length(text_col)).cast("bigint").alias("total_chars"),
        F.avg(F.length(text_col)).alias("avg_chars_per_text"),
    )


def event_basics(events: DataFrame) -> DataFrame:
    """Add ``duration_seconds`` (end minus start, to the microsecond) and
    ``ram_usage_delta_mb`` (end minus start, null unless both are known)."""
    elapsed = F.timestamp_diff("MICROSECOND", F.col("timestamp_start_iso"), F.col("timestamp_end_iso")) / 1e6
    return events.withColumns({
        "duration_seconds": elapsed,
        "ram_usage_delta_mb": F.col("ram_usage_end_mb") - F.col("ram_usage_start_mb")})


def event_metrics(events: DataFrame) -> DataFrame:
    """Add the derived inference-event fields.

    seconds_per_text only when texts > 0 and duration > 0; seconds_per_1k_chars
    only when chars > 0 and duration > 0; avg_chars_per_text when texts > 0.
    """
    d = F.col("duration_seconds")
    n = F.col("num_texts_processed")
    c = F.col("total_chars_processed")
    inference = F.col("event_type") == "inference_run"
    return events.select(
        "*",
        F.when(inference & (n > 0), c.cast("double") / n).alias("avg_chars_per_text"),
        F.when(inference & (n > 0) & (d > 0), d / n).alias("seconds_per_text"),
        F.when(inference & (c > 0) & (d > 0), (d / c) * 1000).alias("seconds_per_1k_chars"),
    )


def performance_facts(records: DataFrame) -> DataFrame:
    """Add the derived fields of performance records (A17): ``sentences_per_second``,
    texts by the inference seconds rounded to 2 places, 0 where these are 0; and
    ``model_ram_footprint_mb``, memory after loading less memory before, both rounded.
    All are rounded to 2 places, exact values half to even; null inputs give null."""
    def two(c):
        return fixed_decimals(c, 2).cast("double")

    seconds = two("inference_time_s")
    rate = F.when(seconds > 0, F.col("num_sentences_processed") / seconds) \
        .when(seconds.isNotNull() & F.col("num_sentences_processed").isNotNull(), F.lit(0.0))
    footprint = two("ram_after_load_mb") - two("ram_before_load_mb")
    return records.withColumns({"sentences_per_second": two(rate), "model_ram_footprint_mb": two(footprint)})


def pc_compatibility(events: DataFrame, profiles=spec.PC_PROFILES) -> DataFrame:
    """Compatibility of every inference event with each hardware profile.

    Events without a RAM delta or time per text get one row with status
    ``insufficient data`` and no profile.  Limits are inclusive (``<=``).
    """
    inf = events.where(F.col("event_type") == "inference_run")
    ram = F.col("ram_usage_delta_mb")
    spt = F.col("seconds_per_text")
    sufficient = ram.isNotNull() & spt.isNotNull()
    # The texts of a limit are made once here, those of an event once before it is paired.
    profile_array = F.array(*[
        F.struct(F.lit(name).alias("profile"), F.lit(max_ram).alias("max_ram_delta_mb"),
                 F.lit(max_time).alias("max_seconds_per_text"), F.lit(f"{max_ram:.2f}").alias("ram_text"),
                 F.lit(f"{max_time:.2f}").alias("time_text"))
        for name, max_ram, max_time in profiles
    ])
    none = F.array(F.lit(None).cast(T.StructType([
        T.StructField("profile", T.StringType()), T.StructField("max_ram_delta_mb", T.DoubleType()),
        T.StructField("max_seconds_per_text", T.DoubleType()), T.StructField("ram_text", T.StringType()),
        T.StructField("time_text", T.StringType())])))
    least_ram = min((limit for _, limit, _ in profiles), default=0.0)
    least_time = min((limit for _, _, limit in profiles), default=0.0)
    rows = inf.select("event_id", "ram_usage_delta_mb", "seconds_per_text",
                      F.when(sufficient & (ram > least_ram), fixed_decimals(ram, 2)).alias("ram_text"),
                      F.when(sufficient & (spt > least_time), fixed_decimals(spt, 4)).alias("time_text"),
                      F.explode(F.when(sufficient, profile_array).otherwise(none)).alias("p"))
    p = F.col("p")
    ram_ok = ram <= p["max_ram_delta_mb"]
    time_ok = spt <= p["max_seconds_per_text"]
    ram_note = F.concat(F.lit("May struggle on "), p["profile"], F.lit(" due to RAM usage (needs "),
                        F.col("ram_text"), F.lit("MB delta, profile target <"), p["ram_text"], F.lit("MB)."))
    time_note = F.concat(F.lit("May be too slow for "), p["profile"], F.lit(" (takes "),
                         F.col("time_text"), F.lit("s/email, profile target <"), p["time_text"], F.lit("s)."))
    notes = F.when(ram_ok & time_ok, F.concat(F.lit("Likely compatible with: "), p["profile"])) \
        .otherwise(F.concat_ws(" ", F.when(~ram_ok, ram_note), F.when(~time_ok, time_note)))
    return rows.select(
        "event_id",
        p["profile"].alias("profile"),
        F.when(p["profile"].isNull(), F.lit("insufficient data"))
        .when(ram_ok & time_ok, F.lit("compatible")).otherwise(F.lit("not compatible")).alias("status"),
        ram_ok.alias("ram_ok"),
        time_ok.alias("time_ok"),
        F.when(p["profile"].isNotNull(), notes).alias("notes"),
    )


def throughput(num_sentences: int, inference_time_s: float) -> float:
    """Sentences per second from the rounded inference time (0 when no time)."""
    t = round(inference_time_s, 2)
    return round(num_sentences / t, 2) if t > 0 else 0.0
