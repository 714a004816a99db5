"""Steps of the training loop."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from labelforge.operators import network as net


def _staged(spark):
    vector = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.xxhash64("id", i) % 1000 / 1000).cast("float"))
    df = spark.range(300).select(F.col("id").alias("k"), vector.alias("x"), (F.col("id") % 3).cast("int").alias("y"))
    weights = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.5)], "label int, weight_tempered double")
    return net.staged_batches(df, "x", "y", weights, "k", 100, 42)


def test_a_step_plans_no_query(spark, monkeypatch):
    batches, dim = _staged(spark)
    model = net.initial_weights([dim, 5, 3], 1)
    order = np.arange(len(batches))
    planned, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *args, **named: planned.append(1) or plain(self, *args, **named))
    one, loss, _ = net.run_epoch(batches, model, net.Adam(), order, 0.2, 3)
    first = len(planned)
    other, again, _ = net.run_epoch(batches, model, net.Adam(), order, 0.2, 3)
    assert len(planned) == first <= len(batches) > 1
    assert loss == again and all(np.array_equal(a, b) for p, q in zip(one, other) for a, b in zip(p, q))


def test_kept_blocks_are_released(spark):
    batches, dim = _staged(spark)
    net.batch_sums(batches[0], net.initial_weights([dim, 5, 3], 1))
    assert batches[0].held.is_cached
    batches[0].release()
    assert not batches[0].held.is_cached
