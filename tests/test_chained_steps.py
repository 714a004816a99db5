"""Training steps that one task takes, and what is staged for them."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from labelforge.operators import embed as emb
from labelforge.operators import network as net


def _staged(spark, rows=300):
    vector = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.xxhash64("id", i) % 1000 / 1000).cast("float"))
    df = spark.range(rows).select(F.col("id").alias("k"), vector.alias("x"), (F.col("id") % 3).cast("int").alias("y"))
    weights = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.5)], "label int, weight_tempered double")
    return net.staged_batches(df, "x", "y", weights, "k", 50, 42)


def _jobs(spark, group, run):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_epochs_of_small_batches_are_one_job(spark, monkeypatch):
    batches, dim = _staged(spark)
    rng = np.random.default_rng(1)
    orders = [rng.permutation(len(batches)) for _ in range(3)]
    start = net.initial_weights([dim, 5, 3], 1)

    def run():
        adam = net.Adam(0.05)
        return *net.run_epochs(batches, start, adam, orders, 0.2, 3), adam.steps

    (model, loss, acc, steps), jobs = _jobs(spark, "chained", run)
    assert jobs == 1 and steps == 3 * len(batches) == 18
    monkeypatch.setattr(net, "CHAIN_BYTES", 2 * batches[0].size)   # two batches a task
    two, more = _jobs(spark, "by two", run)
    assert 1 < more < 18
    monkeypatch.setattr(net, "MAX_CHAINED", 0)                     # a large model: one step a job
    single, most = _jobs(spark, "single", run)
    assert most == 18
    for other in (two, single):
        assert other[1:] == (loss, acc, steps)
        assert all(np.array_equal(a, b) for p, q in zip(model, other[0]) for a, b in zip(p, q))


def test_a_batch_is_one_file_however_many_rows_there_are(spark, monkeypatch):
    monkeypatch.setattr(net, "STAGE_BYTES", 50 * 8 * 8 * 2)        # two batches
    batches, _ = _staged(spark, 1000)
    files = batches[0].rows.inputFiles()                           # of all batches
    assert len(batches) == len(files) == len({f.rsplit("/", 1)[0] for f in files}) == 20
    assert all(b.parts == 1 for b in batches)


def test_a_task_never_holds_more_than_a_chain(spark, monkeypatch):
    batches, _ = _staged(spark)
    monkeypatch.setattr(net, "CHAIN_BYTES", 2 * batches[0].size)
    runs = list(net._chains(batches, [0, 1, 0, 2, 3, 3, 0], 100))
    assert runs == [[0, 1, 0], [2, 3, 3], [0]]
    assert list(net._chains(batches, [0, 1], net.MAX_CHAINED + 1)) == [[0], [1]]


def test_vectors_follow_the_definition(monkeypatch):
    monkeypatch.setattr(emb.TokenHashes, "MOST", 3)
    emb._HASHES.clear()
    texts = ["a b a", None, "", "!", "é " * 5 + "x" * 100, "a b c d e f g a"]
    got = emb.hashing_encoder(16, "p ", False)(np.array(texts, dtype=object))
    for text, row in zip(texts, got):
        want = np.zeros(16)
        for token in [] if text is None else emb._TOKEN.findall(f"p {text}".lower()):
            h = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
            want[h % 16] += -1 if h >> 31 else 1
        assert row.dtype == np.float32 and (row == want).all()
    assert len(emb._HASHES) <= 3 and "x" * 100 not in emb._HASHES
