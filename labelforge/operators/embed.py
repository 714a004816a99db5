"""Batch text embedding (M4, X14) and the encoder throughput job.

Encoders are loaded once per Python worker by ``predict_batch_udf`` and fed
Arrow batches of ``batch_size`` texts.  Any encoder with the signature
``encode(texts: np.ndarray[str]) -> np.ndarray[n, dim]`` plugs in; the
offline default is a signed feature-hashing encoder of word tokens (real
sentence encoders are not installed in this environment).
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge import spec
from labelforge.operators.partitioning import spread

_TOKEN = re.compile(r"\w+", re.UNICODE)


class TokenHashes(dict):
    """The first 32 bits of a token's md5, kept for up to ``MOST`` tokens of up to ``LONG``
    characters."""

    MOST, LONG = 1 << 18, 64

    def __missing__(self, token: str) -> int:
        h = int.from_bytes(hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()[:4], "big")
        if len(self) >= self.MOST:
            self.clear()
        if len(token) <= self.LONG:
            self[token] = h
        return h


_HASHES = TokenHashes()


def hashing_encoder(dim: int = 64, prefix: str | None = None, normalize: bool = True):
    """Factory for the offline encoder: token counts hashed into ``dim``
    signed buckets (md5), optional prefix, optional L2 normalisation."""

    def encode(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in enumerate(texts):
            if text is None:
                continue
            s = text if prefix is None else prefix + text
            tokens = _TOKEN.findall(s.lower())
            h = np.fromiter(map(_HASHES.__getitem__, tokens), np.int64, len(tokens))
            out[row] = np.bincount(h % dim, 1 - 2 * (h >> 31), dim)
        if normalize:
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            out = out / np.maximum(norms, 1e-12)
        return out

    return encode


def embed_udf(make_encoder: Callable[[], Callable], batch_size: int = 32):
    """A ``predict_batch_udf`` returning ARRAY<FLOAT> per text."""
    return predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def embed_texts(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 64,
                prefix_name: str = "none", normalize: bool = True, batch_size: int = 32,
                make_encoder: Callable[[], Callable] | None = None) -> DataFrame:
    prefix = spec.prefix_for(prefix_name)
    factory = make_encoder or (lambda: hashing_encoder(dim, prefix, normalize))
    return spread(df).withColumn(out_col, embed_udf(factory, batch_size)(F.col(text_col)))


def hashing_tf_embed(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 64,
                     prefix_name: str = "none", normalize: bool = True) -> DataFrame:
    """JVM-only fallback encoder: word tokens -> hashed term counts -> L2.

    Spark ML ``RegexTokenizer`` + ``HashingTF`` (+ ``Normalizer``), then
    ``vector_to_array``; no Python worker is involved.  Use it when no
    external model is plugged in; ``embed_texts`` is the path for real
    encoders.
    """
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    prefix = spec.prefix_for(prefix_name)
    src = F.col(text_col) if prefix is None else F.concat(F.lit(prefix), F.col(text_col))
    staged = df.withColumn("_lf_in", F.coalesce(src, F.lit("")))
    tokens = RegexTokenizer(inputCol="_lf_in", outputCol="_lf_tok", pattern=r"\w+", gaps=False,
                            toLowercase=True).transform(staged)
    tf = HashingTF(inputCol="_lf_tok", outputCol="_lf_tf", numFeatures=dim).transform(tokens)
    vec_col = "_lf_tf"
    if normalize:
        tf = Normalizer(inputCol="_lf_tf", outputCol="_lf_norm", p=2.0).transform(tf)
        vec_col = "_lf_norm"
    out = tf.withColumn(out_col, vector_to_array(vec_col, "float32"))
    return out.drop("_lf_in", "_lf_tok", "_lf_tf", "_lf_norm")


def encode_throughput(spark: SparkSession, texts: DataFrame, text_col: str, model_name: str,
                      dim: int = 64, prefix_name: str = "none", normalize: bool = False,
                      batch_size: int = 64, warmup_rows: int = 256,
                      make_encoder: Callable[[], Callable] | None = None) -> DataFrame:
    """Warm up on ``warmup_rows`` texts, then time the encode of every text
    through a no-op sink.  One result row; the texts and those without a vector
    (``num_failed``) are counted by the timed job itself, and an encoder failure is
    recorded in ``error`` instead of failing the job."""
    record = {"model_name": model_name, "prefix_function_name": prefix_name,
              "normalize_embeddings_in_encode_call": normalize, "batch_size": batch_size,
              "warmup_runs": warmup_rows, "num_sentences_processed": None, "num_failed": None,
              "inference_time_s": None, "sentences_per_second": None,
              "output_embedding_dim": None, "error": None}
    try:
        embedded = embed_texts(texts.select(text_col), text_col, "e", dim, prefix_name, normalize, batch_size,
                               make_encoder)
        embedded.limit(warmup_rows).write.format("noop").mode("overwrite").save()
        counts = Observation()
        timed = embedded.observe(counts, F.count(F.lit(1)).alias("n"), F.count_if(F.col("e").isNull()).alias("failed"))
        start = time.perf_counter()
        timed.write.format("noop").mode("overwrite").save()
        elapsed = time.perf_counter() - start
        n, failed = counts.get["n"], counts.get["failed"]
        t = round(elapsed, 2)
        record.update(num_sentences_processed=n, num_failed=failed, inference_time_s=t,
                      sentences_per_second=round(n / t, 2) if t > 0 else 0.0,
                      output_embedding_dim=dim)
    except Exception as exc:  # the run still yields a record
        record["error"] = f"{type(exc).__name__}: {exc}"
    schema = T.StructType([
        T.StructField("model_name", T.StringType()), T.StructField("prefix_function_name", T.StringType()),
        T.StructField("normalize_embeddings_in_encode_call", T.BooleanType()),
        T.StructField("batch_size", T.LongType()), T.StructField("warmup_runs", T.LongType()),
        T.StructField("num_sentences_processed", T.LongType()), T.StructField("num_failed", T.LongType()),
        T.StructField("inference_time_s", T.DoubleType()),
        T.StructField("sentences_per_second", T.DoubleType()), T.StructField("output_embedding_dim", T.LongType()),
        T.StructField("error", T.StringType()),
    ])
    return spark.createDataFrame([tuple(record[f.name] for f in schema.fields)], schema)
