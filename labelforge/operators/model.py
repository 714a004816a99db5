"""Classifiers on embeddings: Spark ML training, stored models, class means.

``network`` trains with exact class weights and keeps its model as a table, which
``save_model``, ``load_model`` and ``predict`` work on.

``train_mlp`` uses Spark ML's ``MultilayerPerceptronClassifier`` (layers
``[dim, hidden, k]``), run in rounds that continue from the previous weights
(``initialWeights``); after every round the class-weighted validation loss
decides improvement, and training stops after ``patience`` rounds without
one.  The round loop is the only driver-side iteration; every round is a
distributed fit plus two aggregate passes.  Spark's MLP has no sample
weights, so the class weights enter the fit as copies of rows: a row whose
class has ``r`` times the smallest weight is fitted floor(r) times and, for
the rest of ``r``, once more with that chance (by a hash of its key, alike
on every run).  Losses are taken on the rows themselves, with the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge import spec
from labelforge.functions import vectors
from labelforge.operators import network
from labelforge.operators.partitioning import spread

MAX_MODEL_FLOATS = 10_000_000  # size bound for parameters shipped to tasks


def _weighted_metrics(pred: DataFrame, label_col: str, weights: DataFrame) -> tuple[float, float]:
    w = F.broadcast(weights.select(F.col("label").alias("_lf_l"), F.col("weight_tempered").alias("_lf_w")))
    j = pred.join(w, pred[label_col] == w["_lf_l"], "left")  # a class without a weight counts in the accuracy only
    p_true = F.get(vector_to_array("probability"), F.col(label_col).cast("int"))
    nll = -F.log(F.greatest(p_true, F.lit(1e-15)))
    row = j.agg(F.coalesce(F.try_divide(F.sum(F.col("_lf_w") * nll), F.sum("_lf_w")), F.lit(0.0)).alias("loss"),
                F.avg((F.col("prediction") == F.col(label_col)).cast("double")).alias("acc")).first()
    return float(row["loss"]), float(row["acc"])


def _copies(df: DataFrame, label_col: str, weights: DataFrame, key: Column) -> DataFrame:
    """Every row as often as its class weight asks for, numbered in ``_lf_copy``
    from 0; rows of a class without a weight stay once."""
    least = F.min("weight_tempered").over(Window.partitionBy())  # one row per class
    ratio = weights.where("weight_tempered > 0").select(
        F.col("label").alias("_lf_l"), (F.col("weight_tempered") / least).alias("_lf_r"))
    chance = F.pmod(F.xxhash64(key, F.lit("copy")), F.lit(1 << 20)) / float(1 << 20)
    r = F.coalesce("_lf_r", F.lit(1.0))
    n = F.floor(r).cast("int") + (chance < r - F.floor(r)).cast("int")
    return df.join(F.broadcast(ratio), df[label_col] == F.col("_lf_l"), "left") \
        .withColumn("_lf_copy", F.explode(F.sequence(F.lit(0), n - 1))).drop("_lf_l", "_lf_r")


def train_mlp(train: DataFrame, val: DataFrame, features_col: str, label_col: str, weights: DataFrame,
              num_classes: int, hidden: int = 128, iters_per_round: int = 5, max_rounds: int = 1000,
              patience: int = spec.PATIENCE, seed: int = spec.SEED, order_col: str | None = None):
    """Returns ``(best_model, metrics_rows)``; one metrics row per round.

    With ``order_col`` the rows are range-partitioned and sorted by it, so
    the optimiser sees the same partitions in the same order on every run
    (shuffle output order is otherwise arbitrary, and floating sums with it).
    """
    def prepared(df: DataFrame, *extra: str) -> DataFrame:
        cols = [array_to_vector(F.col(features_col)).alias("features"),
                F.col(label_col).cast("double").alias("label"), *extra]
        if order_col is None:
            return df.select(*cols).persist()
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # grows with the data
        ordered = df.select(F.col(order_col).alias("_lf_o"), *cols).repartitionByRange(n, "_lf_o") \
            .sortWithinPartitions("_lf_o", *extra)
        return ordered.drop("_lf_o").persist()

    fitted = prepared(_copies(train, label_col, weights, F.col(order_col or features_col)), "_lf_copy")
    tr = fitted.where("_lf_copy = 0")
    va = prepared(val)
    dim = len(tr.first()["features"])
    layers = [dim, hidden, num_classes]
    best, best_loss, since, weights_vec, rows = None, float("inf"), 0, None, []
    try:
        for epoch in range(max_rounds):
            mlp = MultilayerPerceptronClassifier(layers=layers, maxIter=iters_per_round, seed=seed,
                                                 blockSize=128)
            if weights_vec is not None:
                mlp.setInitialWeights(weights_vec)
            model = mlp.fit(fitted)
            weights_vec = model.weights
            tl, ta = _weighted_metrics(model.transform(tr), "label", weights)
            vl, vacc = _weighted_metrics(model.transform(va), "label", weights)
            improved = vl < best_loss
            rows.append((epoch, tl, ta, vl, vacc, improved))
            if improved:
                best, best_loss, since = model, vl, 0
            else:
                since += 1
                if since >= patience:
                    break
    finally:
        fitted.unpersist()
        va.unpersist()
    return best, rows


METRICS_SCHEMA = T.StructType([
    T.StructField("epoch", T.LongType()), T.StructField("train_loss", T.DoubleType()),
    T.StructField("train_acc", T.DoubleType()), T.StructField("val_loss", T.DoubleType()),
    T.StructField("val_acc", T.DoubleType()), T.StructField("improved", T.BooleanType()),
    T.StructField("learning_rate", T.DoubleType()),
])


def save_model(weights: network.Weights, path: str) -> None:
    network.save_network(SparkSession.active(), weights, path)


def load_model(path: str) -> DataFrame:
    return network.load_network(SparkSession.active(), path)


def predict(model: DataFrame, df: DataFrame, features_col: str, out_col: str = "pred_label",
            max_shipped: int = network.MAX_SHIPPED) -> DataFrame:
    """Batch prediction with a stored model (index of the largest output)."""
    scored = network.apply_network(df, model, features_col, "_lf_logits", max_shipped)
    return scored.withColumn(out_col, vectors.argmax("_lf_logits")).drop("_lf_logits")


# -- X16: forward pass with given weights ------------------------------------------

def mlp_forward_udf(weights: list[tuple[np.ndarray, np.ndarray]], batch_size: int = 64):
    """``Linear -> ReLU`` for every hidden layer, then ``Linear``; returns the
    logits.  Dropout is off at inference.  ``weights`` is a list of
    (matrix [in, out], bias [out]) and is shipped once per task."""
    total = sum(w.size + b.size for w, b in weights)
    if total > MAX_MODEL_FLOATS:
        raise ValueError(f"model has {total} parameters, above the shipping bound")
    frozen = [(np.asarray(w, dtype=np.float32), np.asarray(b, dtype=np.float32)) for w, b in weights]

    def make():
        def forward(x: np.ndarray) -> np.ndarray:
            h = x.astype(np.float32)
            for i, (w, b) in enumerate(frozen):
                h = h @ w + b
                if i < len(frozen) - 1:
                    h = np.maximum(h, 0.0)
            return h
        return forward

    dim = frozen[0][0].shape[0]
    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                             input_tensor_shapes=[[dim]])


# -- M8: evaluation from stored embeddings (nearest centroid) -----------------------

def centroids(train: DataFrame, features_col: str, label_col: str) -> DataFrame:
    """Mean vector per class: one map-side combined aggregate over the vectors.
    Rows without a vector or a label don't count."""
    rows = train.where(F.col(features_col).isNotNull() & F.col(label_col).isNotNull())
    mean = Summarizer.mean(array_to_vector(F.transform(features_col, lambda x: x.cast("double"))))
    return rows.groupBy(F.col(label_col).cast("int").alias("label")).agg(vector_to_array(mean).alias("centroid"))


def _unit_rows(cents: DataFrame) -> tuple[list[int], np.ndarray]:
    """The labels in order and their unit vectors: k x dim numbers of model state,
    checked for size before they reach the driver and the tasks."""
    size = cents.agg(F.sum(F.size("centroid"))).first()[0] or 0
    if size > MAX_MODEL_FLOATS:
        raise ValueError(f"class means hold {size} numbers, above the shipping bound")
    rows = cents.select("label", vectors.l2_normalize("centroid").alias("unit")).orderBy("label").collect()
    return [r["label"] for r in rows], np.array([r["unit"] for r in rows], dtype=np.float64)


def _cosines(units: np.ndarray):
    """An Arrow function: the cosine of every vector to every unit row, one matrix
    product a batch.  A null vector, one with a null entry or of another length
    gives null."""
    dim = units.shape[1] if units.ndim == 2 else 0

    def score(vecs: pa.Array) -> pa.Array:
        lengths = vecs.value_lengths().to_numpy(zero_copy_only=False)
        flat = vecs.flatten()
        if vecs.null_count or flat.null_count or (lengths != dim).any():
            rows = vecs.to_pylist()
            good = np.array([r is not None and len(r) == dim and None not in r for r in rows], dtype=bool)
            x = np.array([r for r, ok in zip(rows, good) if ok], dtype=np.float64).reshape(-1, dim)
        else:
            good = np.ones(len(vecs), dtype=bool)
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        norms = np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
        cos = (x @ units.T) / norms
        offsets = np.concatenate([[0], np.cumsum(good)]) * units.shape[0]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(cos.ravel()),
                                        mask=pa.array(~good) if not good.all() else None)

    return F.arrow_udf(score, "array<double>")


def _scored(df: DataFrame, units: np.ndarray, features_col: str, out_col: str) -> DataFrame:
    if not len(units):
        return df.withColumn(out_col, F.array().cast("array<double>"))
    return spread(df).withColumn(out_col, _cosines(units)(F.col(features_col)))


def centroid_scores(df: DataFrame, cents: DataFrame, features_col: str, out_col: str = "scores") -> DataFrame:
    """Add the cosine similarity to every centroid, in order of the labels (null for
    a vector of another length or with a null)."""
    return _scored(df, _unit_rows(cents)[1], features_col, out_col)


def centroid_predict(df: DataFrame, cents: DataFrame, features_col: str,
                     out_col: str = "pred_label") -> DataFrame:
    """Predict the class of the most similar centroid (first on ties)."""
    labels, units = _unit_rows(cents)
    scored = _scored(df, units, features_col, "_lf_scores")
    names = F.array(*[F.lit(x) for x in labels]).cast("array<int>")
    return scored.withColumn(out_col, F.get(names, vectors.argmax("_lf_scores"))).drop("_lf_scores")
