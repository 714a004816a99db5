"""Incremental mail cleaning with Structured Streaming.

The reference has no streaming operators.  The row-wise operators (mail
cleaning, crosswalk, dominant label, event derivations) are plain column
expressions, so the same functions run on a streaming DataFrame: new raw-mail
files dropped into a folder are cleaned and appended to a Parquet sink,
exactly once per file, with the progress kept in a checkpoint below the
shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from labelforge.functions.text import clean_mail, drop_empty
from labelforge.session import scratch_path

RAW_MAIL_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()),
                                T.StructField("message", T.StringType())])


def cleaned_stream(spark: SparkSession, source_dir: str,
                   schema: T.StructType = RAW_MAIL_SCHEMA) -> DataFrame:
    raw = spark.readStream.schema(schema).parquet(source_dir)
    return drop_empty(clean_mail(raw, "message", "preprocessed_text"), "preprocessed_text") \
        .select("doc_id", "preprocessed_text")


def run_clean_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                     checkpoint_dir: str | None = None) -> None:
    """Process every file currently in ``source_dir`` and stop (availableNow)."""
    checkpoint_dir = checkpoint_dir or scratch_path(spark, "mail-stream-ckpt")
    q = (cleaned_stream(spark, source_dir).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
