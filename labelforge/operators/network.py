"""A feed-forward classifier whose training and model are Spark data.

Training: the rows are staged once, dealt into batches by a hash of their key; a
step reads one batch, every partition sums the gradients of its rows with the
weight of their class, the sums are combined in two levels and the driver takes one
Adam step.  Steps on batches of one partition follow one another in one task, which
holds up to ``CHAIN_BYTES`` of rows, the model and its Adam state.  An epoch reads the
batches in a seeded order; the class-weighted loss of a batch is a weighted mean, that
of an epoch the mean over its batches weighted by rows.  A plateau of the validation
loss cuts the learning rate, which is recorded.

Model: a table of (layer, block, first, width, weights, bias) rows, a block being some input
rows of a layer's matrix.  A model of up to ``MAX_SHIPPED`` numbers travels to the
tasks; a larger one is joined with the blocks of the vectors, layer by layer.

Rows without a vector or a label don't count.  A row whose class has no weight counts
in the accuracy only.  Without any row the series is empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.session import scratch_path

MAX_SHIPPED = 10_000_000   # numbers of a model that travels whole
BLOCK = 1024               # input rows of a matrix in a block
GROUP_ROWS = 20_000        # vectors multiplied with a block at once
STAGE_BYTES = 64 << 20     # vectors a partition
WIDE = 64                  # partial sums that the driver takes without a level between
CHAIN_BYTES = 64 << 20     # rows that a task holds for the steps that it takes one after the other
MAX_CHAINED = 1_000_000    # numbers of a model that travels to such a task and back
MODEL_SCHEMA = ("layer int, block int, first int, width int, "
                "weights array<double>, bias array<double>")
Weights = list[tuple[np.ndarray, np.ndarray]]


def initial_weights(layers: list[int], seed: int = spec.SEED) -> Weights:
    """Uniform within 1 / sqrt(inputs), for weights and biases."""
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a))
            for a, b in zip(layers, layers[1:])]


def forward(x: np.ndarray, weights: Weights, masks: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """The input and the output of every layer; hidden ones are rectified and, with
    ``masks``, thinned."""
    out = [x]
    for i, (w, b) in enumerate(weights):
        x = x @ w
        x += b
        if i < len(weights) - 1:
            np.maximum(x, 0.0, out=x)
            if masks is not None:
                x *= masks[i]
        out.append(x)
    return out


@dataclass
class Sums:
    """What a set of rows adds to a step: weighted loss, weight, rows, right answers, gradients."""

    loss: float = 0.0
    weight: float = 0.0
    rows: int = 0
    right: int = 0
    gradients: list[np.ndarray] = field(default_factory=list)

    def add(self, other: Sums) -> None:
        self.loss, self.weight = self.loss + other.loss, self.weight + other.weight
        self.rows, self.right = self.rows + other.rows, self.right + other.right
        self.gradients = [a + b for a, b in zip(self.gradients, other.gradients)] if self.gradients else other.gradients

    def counts(self) -> Sums:
        """All but the gradients."""
        return Sums(self.loss, self.weight, self.rows, self.right)


def loss_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: Weights, gradients: bool = True,
              masks: list[np.ndarray] | None = None) -> Sums:
    """Sums over rows of the weighted cross-entropy and of its gradient."""
    layers = forward(x, weights, masks)
    logits = layers[-1] - layers[-1].max(axis=1, keepdims=True)
    p = np.exp(logits)
    total = p.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    out = Sums(float((w * (np.log(total[:, 0]) - logits[at, y])).sum()), float(w.sum()), len(y),
               int((layers[-1].argmax(axis=1) == y).sum()))
    if gradients:
        back = p / total
        back[at, y] -= 1.0
        back *= w[:, None]
        for i in range(len(weights) - 1, -1, -1):
            out.gradients[:0] = [layers[i].T @ back, back.sum(axis=0)]
            if i:
                back = back @ weights[i][0].T
                back *= layers[i] > 0
                if masks is not None:
                    back *= masks[i - 1]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _masks(rng: np.random.Generator, rows: int, weights: Weights, dropout: float) -> list[np.ndarray]:
    out = []
    for w, _ in weights[:-1]:
        mask = rng.random((rows, w.shape[1]))
        np.greater_equal(mask, dropout, out=mask)
        mask *= 1.0 / (1.0 - dropout)
        out.append(mask)
    return out


@dataclass
class Batch:
    """Staged rows (x, y, w, batch) with the number of the batch and their bytes, about."""

    rows: DataFrame
    number: int
    size: int
    held: RDD | None = None

    def blocks(self) -> RDD:
        """The rows as (batch, partition, x, y, w) arrays, kept after their first use: a step
        then is part of a small job without a query to plan."""
        if self.held is None:
            def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        arrays = [b["x"].flatten(), b["y"], b["w"]]
                        raw = [pa.array([a.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for a in arrays]
                        yield pa.RecordBatch.from_arrays([b["part"].slice(0, 1), *raw], ["part", "x", "y", "w"])

            packed = self.rows.select("x", "y", "w", F.spark_partition_id().alias("part")).mapInArrow(
                pack, "part int, x binary, y binary, w binary")
            number = self.number
            self.held = packed.rdd.map(lambda r: (number, r["part"], bytes(r["x"]), bytes(r["y"]), bytes(r["w"]))) \
                .persist(StorageLevel.MEMORY_AND_DISK)
        return self.held

    @property
    def parts(self) -> int:
        return self.blocks().getNumPartitions()

    def release(self) -> None:
        if self.held is not None:
            self.held.unpersist()
        if self.rows.is_cached:
            self.rows.unpersist()


def keep_blocks(batches: list[Batch]) -> None:
    """Make the blocks of all batches in one job, side by side."""
    narrow = [b.blocks() for b in batches if b.parts <= WIDE]
    if narrow:
        batches[0].rows.sparkSession.sparkContext.union(narrow).foreachPartition(lambda blocks: None)


def _arrays(x: bytes, y: bytes, w: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(x).reshape(-1, width), np.frombuffer(y, np.int64), np.frombuffer(w)


def _block_sums(blocks: Iterable[tuple], weights: Weights, dropout: float, seed: int) -> Iterator[tuple[int, Sums]]:
    """(partition, sums) of the blocks of one partition."""
    s, part, rng = Sums(), None, None
    for _, number, *raw in blocks:
        if part is None:
            part, rng = number, np.random.default_rng((seed, number))
        x, y, w = _arrays(*raw, weights[0][0].shape[0])
        masks = _masks(rng, len(x), weights, dropout) if dropout else None
        s.add(loss_sums(x, y, w, weights, True, masks))
    if part is not None:
        yield part, s


def batch_sums(batch: Batch, weights: Weights, dropout: float = 0.0, seed: int = 0) -> Sums:
    """``loss_sums`` of a staged batch: one row of sums a partition, combined by the
    partition's number so that reruns agree; many partitions are first combined in
    a level of about the square root of their number."""
    if batch.parts <= WIDE:
        out = Sums()
        step = functools.partial(_block_sums, weights=weights, dropout=dropout, seed=seed)
        for _, s in sorted(batch.blocks().mapPartitions(step).collect(), key=lambda found: found[0]):
            out.add(s)
        return out
    spark = batch.rows.sparkSession
    if not batch.rows.is_cached:
        batch.rows.persist()
    shapes = [m.shape for pair in weights for m in pair]
    shared = spark.sparkContext.broadcast(weights)

    def unpack(raw: bytes) -> list[np.ndarray]:
        flat, at, out = np.frombuffer(raw), 0, []
        for shape in shapes:
            size = int(np.prod(shape))
            out.append(flat[at:at + size].reshape(shape))
            at += size
        return out

    def row(part: int, s: Sums) -> pa.RecordBatch:
        raw = b"".join(np.ascontiguousarray(g).tobytes() for g in s.gradients)
        return pa.RecordBatch.from_pylist([{"part": part, "loss": s.loss, "weight": s.weight, "rows": s.rows,
                                            "right": s.right, "gradients": raw}], schema=arrow)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, part, rng = Sums(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            if part is None:
                part = b["part"][0].as_py()
                rng = np.random.default_rng((seed, part))
            x = _matrix(b["x"], shapes[0][0])
            masks = _masks(rng, len(x), shared.value, dropout) if dropout else None
            s.add(loss_sums(x, b["y"].to_numpy(), b["w"].to_numpy(), shared.value, True, masks))
        if part is not None:
            yield row(part, s)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, part = Sums(), None
        for b in batches:
            for r in b.to_pylist():
                part = r["part"] if part is None else part
                s.add(Sums(r["loss"], r["weight"], r["rows"], r["right"], unpack(r["gradients"])))
        if part is not None:
            yield row(part, s)

    schema = "part int, loss double, weight double, rows bigint, right bigint, gradients binary"
    arrow = pa.schema([("part", pa.int32()), ("loss", pa.float64()), ("weight", pa.float64()), ("rows", pa.int64()),
                       ("right", pa.int64()), ("gradients", pa.binary())])
    sums = batch.rows.select("x", "y", "w", F.spark_partition_id().alias("part")).mapInArrow(partial, schema)
    groups = int(np.ceil(np.sqrt(batch.parts)))
    sums = sums.repartitionByRange(groups, "part").sortWithinPartitions("part").mapInArrow(combine, schema)
    out = Sums()
    for r in sorted(sums.collect(), key=lambda r: r.part):
        out.add(Sums(r.loss, r.weight, r.rows, r.right, unpack(bytes(r.gradients))))
    shared.unpersist()
    return out


def staged_batches(df: DataFrame, features: str, label: str, weights: DataFrame, key: str, batch_rows: int,
                   seed: int) -> tuple[list[Batch], int]:
    """The rows as (x, y, w) in batches of about ``batch_rows`` by a hash of the key,
    written once in order of the key; and the vectors' length.

    ``weights`` has one row per class."""
    spark = df.sparkSession
    rows = df.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size(features))).first()
    if not n:
        return [], 0
    count = max(1, round(n / batch_rows))
    size = -(-n * dim * 8 // count)
    tasks, parts = (max(1, -(-b // STAGE_BYTES)) for b in (n * dim * 8, size))
    by_class = F.broadcast(weights.select(F.col("label").alias("_lf_l"), F.col("weight_tempered").alias("_lf_w")))
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows = (rows.join(by_class, F.col(label) == F.col("_lf_l"), "left")
            .select(F.pmod(h, F.lit(count)).cast("int").alias("batch"), F.col(key).alias("_lf_k"),
                    F.col(features).cast("array<double>").alias("x"), F.col(label).cast("bigint").alias("y"),
                    F.coalesce("_lf_w", F.lit(0.0)).alias("w"), F.shiftright(h, 32).alias("_lf_h")))
    path = scratch_path(spark, "batches")
    # A batch of up to STAGE_BYTES is one file, whatever the number of batches.
    dealt = rows.repartition(tasks, "batch", F.pmod(F.col("_lf_h"), F.lit(parts))) \
        .sortWithinPartitions("batch", "_lf_k", "_lf_h")
    dealt.drop("_lf_h", "_lf_k").write.partitionBy("batch").parquet(path)
    staged = spark.read.schema("x array<double>, y bigint, w double, batch int").parquet(path)
    return [Batch(staged.where(F.col("batch") == b), b, size) for b in range(count)], dim


@dataclass
class Adam:
    """Adam steps; the state is as large as the model."""

    rate: float = 1e-3
    decay: tuple[float, float] = (0.9, 0.999)
    least: float = 1e-8
    steps: int = 0
    mean: list[np.ndarray] = field(default_factory=list)
    square: list[np.ndarray] = field(default_factory=list)

    def step(self, weights: Weights, gradients: list[np.ndarray]) -> Weights:
        a, b = self.decay
        self.steps += 1
        self.mean = [a * m + (1 - a) * g for m, g in zip(self.mean or [0.0] * len(gradients), gradients)]
        self.square = [b * s + (1 - b) * g * g for s, g in zip(self.square or [0.0] * len(gradients), gradients)]
        moved = [self.rate * (m / (1 - a ** self.steps)) / (np.sqrt(s / (1 - b ** self.steps)) + self.least)
                 for m, s in zip(self.mean, self.square)]
        return [(w - moved[2 * i], c - moved[2 * i + 1]) for i, (w, c) in enumerate(weights)]

    def stepped(self, weights: Weights, sums: Sums) -> Weights:
        """A step along the mean gradient; none where no row has a weight."""
        return self.step(weights, [g / sums.weight for g in sums.gradients]) if sums.weight > 0 else weights


@dataclass
class Plateau:
    """Cuts the rate by ``factor`` after more than ``patience`` losses in a row that
    aren't better than the best by one part in 10,000."""

    factor: float = 0.5
    patience: int = 3
    best: float = float("inf")
    bad: int = 0

    def rate(self, rate: float, loss: float) -> float:
        if loss < self.best * (1 - 1e-4):
            self.best, self.bad = loss, 0
        else:
            self.bad += 1
        if self.bad > self.patience:
            self.bad = 0
            return rate * self.factor if rate * (1 - self.factor) > 1e-8 else rate
        return rate


def _mean(parts: list[Sums]) -> tuple[float, float]:
    """Loss and accuracy over batches: weighted mean inside, mean by rows outside."""
    rows = sum(s.rows for s in parts)
    loss = sum((s.loss / s.weight if s.weight else 0.0) * s.rows for s in parts) / rows if rows else 0.0
    return loss, sum(s.right for s in parts) / rows if rows else 0.0


def _chains(batches: list[Batch], order: Iterable[int], numbers: int) -> Iterator[list[int]]:
    """The steps of ``order`` in runs that one task takes: their batches hold ``CHAIN_BYTES``
    at most.  A batch of several partitions and a model above ``MAX_CHAINED`` numbers make
    runs of one step."""
    chain, held, size = [], set(), 0
    for b in order:
        alone = numbers > MAX_CHAINED or batches[b].parts > 1
        if chain and (alone or b not in held and size + batches[b].size > CHAIN_BYTES):
            yield chain
            chain, held, size = [], set(), 0
        if alone:
            yield [b]
            continue
        chain.append(b)
        if b not in held:
            held.add(b)
            size += batches[b].size
    if chain:
        yield chain


def _take_steps(blocks: Iterable[tuple], order: list[int], weights: Weights, adam: Adam, dropout: float,
                seed: int) -> Iterator[tuple[Weights, Adam, list[Sums]]]:
    """Steps on the batches of the numbers ``order``, one after the other."""
    held: dict[int, list[tuple]] = {}
    for block in blocks:
        held.setdefault(block[0], []).append(block)
    seen = []
    for number in order:
        s = Sums()
        for _, found in _block_sums(held.get(number, ()), weights, dropout, seed + adam.steps):
            s.add(found)
        weights = adam.stepped(weights, s)
        seen.append(s.counts())
    yield weights, adam, seen


def run_epochs(batches: list[Batch], weights: Weights, adam: Adam, orders: Sequence[Iterable[int]],
               dropout: float = 0.0, seed: int = 0) -> tuple[Weights, float, float]:
    """One step for every batch in every order; the loss and the accuracy are those seen on
    the way through the last one."""
    sc = batches[0].rows.sparkSession.sparkContext
    orders = [[int(b) for b in order] for order in orders]
    seen: list[Sums] = []
    for chain in _chains(batches, [b for order in orders for b in order], sum(m.size for pair in weights for m in pair)):
        first = batches[chain[0]]
        if len(chain) == 1:
            s = batch_sums(first, weights, dropout, seed + adam.steps)
            weights = adam.stepped(weights, s)
            seen.append(s.counts())
            continue
        step = functools.partial(_take_steps, order=[batches[b].number for b in chain], weights=weights, adam=adam,
                                 dropout=dropout, seed=seed)
        rows = sc.union([batches[b].blocks() for b in dict.fromkeys(chain)]).coalesce(1)
        # Without any row there is no task.
        weights, moved, sums = (rows.mapPartitions(step).collect() or list(step([])))[0]
        adam.steps, adam.mean, adam.square = moved.steps, moved.mean, moved.square
        seen += sums
    return weights, *_mean(seen[len(seen) - len(orders[-1]):])


def run_epoch(batches: list[Batch], weights: Weights, adam: Adam, order: Iterable[int], dropout: float = 0.0,
              seed: int = 0) -> tuple[Weights, float, float]:
    return run_epochs(batches, weights, adam, [order], dropout, seed)


def _block_losses(blocks: Iterable[tuple], weights: Weights) -> Iterator[tuple[int, int, Sums]]:
    for batch, part, *raw in blocks:
        yield batch, part, loss_sums(*_arrays(*raw, weights[0][0].shape[0]), weights, False)


def evaluate_batches(batches: list[Batch], weights: Weights) -> tuple[float, float]:
    """Loss and accuracy of the batches under one model: one job, one row of sums
    a block."""
    if not batches:
        return 0.0, 0.0
    sc = batches[0].rows.sparkSession.sparkContext
    shared = sc.broadcast(weights)
    tasks = max(sc.defaultParallelism, sum(b.size for b in batches) // STAGE_BYTES)
    every = sc.union([b.blocks() for b in batches]).coalesce(tasks)
    found = every.mapPartitions(lambda blocks: _block_losses(blocks, shared.value)).collect()
    sums: dict[int, Sums] = {}
    for batch, _, s in sorted(found, key=lambda f: f[:2]):
        sums.setdefault(batch, Sums()).add(s)
    shared.unpersist()
    return _mean(list(sums.values()))


def train_network(train: DataFrame, val: DataFrame, features: str, label: str, weights: DataFrame, num_classes: int,
                  key: str, hidden: tuple[int, ...] = (128,), learning_rate: float = 1e-3, batch_rows: int = 4096,
                  max_rounds: int = 1000, epochs_per_round: int = 1, patience: int = spec.PATIENCE,
                  dropout: float = 0.2, plateau: Plateau | None = None, seed: int = spec.SEED) -> tuple[Weights, list[tuple]]:
    """(best weights, one row (epoch, train loss, train acc, val loss, val acc, improved,
    learning rate) a round), the round of smallest validation loss being the best.

    The loop on the driver holds the model and its Adam state, never rows."""
    tr, dim = staged_batches(train, features, label, weights, key, batch_rows, seed)
    va, _ = staged_batches(val, features, label, weights, key, batch_rows, seed)
    rows: list[tuple] = []
    try:
        if not tr:
            return [], rows
        model = initial_weights([dim, *hidden, num_classes], seed)
        keep_blocks(tr)
        adam, plateau = Adam(learning_rate), plateau or Plateau()
        rng = np.random.default_rng(seed)
        best, best_loss, since = model, float("inf"), 0
        for number in range(max_rounds):
            orders = [rng.permutation(len(tr)) for _ in range(epochs_per_round)]
            model, loss, acc = run_epochs(tr, model, adam, orders, dropout, seed)
            val_loss, val_acc = evaluate_batches(va, model)
            adam.rate = plateau.rate(adam.rate, val_loss)
            improved = val_loss < best_loss
            rows.append((number, loss, acc, val_loss, val_acc, improved, adam.rate))
            if improved:
                best, best_loss, since = model, val_loss, 0
            else:
                since += 1
                if since >= patience:
                    break
        return best, rows
    finally:
        for b in tr + va:
            b.release()


# -- the model as a table ------------------------------------------------------------

def model_table(spark: SparkSession, weights: Weights, block: int = BLOCK) -> DataFrame:
    """The blocks of a model; the bias goes with the first block of its layer."""
    rows = [(i, b, at, w.shape[1], w[at:at + block].ravel().tolist(), c.tolist() if not b else None)
            for i, (w, c) in enumerate(weights) for b, at in enumerate(range(0, w.shape[0], block))]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def save_network(spark: SparkSession, weights: Weights, path: str, block: int = BLOCK) -> None:
    model_table(spark, weights, block).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_SCHEMA).parquet(path)


def _gathered(model: DataFrame) -> Weights:
    layers: dict[int, list] = {}
    for r in sorted(model.collect(), key=lambda r: (r.layer, r.block)):
        layers.setdefault(r.layer, []).append(r)
    return [(np.concatenate([np.array(r.weights).reshape(-1, r.width) for r in rows]), np.array(rows[0].bias))
            for _, rows in sorted(layers.items())]


def _shipped(df: DataFrame, weights: Weights, features: str, out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list = [None] * b.num_rows
            at = np.flatnonzero(b[features].is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                x = _matrix(b[features].take(pa.array(at)), shared.value[0][0].shape[0])
                for i, v in zip(at, forward(x, shared.value)[-1]):
                    got[i] = v
            yield b.append_column(out, pa.array(got, pa.list_(pa.float64())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` array<double>")


def _blockwise(df: DataFrame, model: DataFrame, features: str, out: str) -> DataFrame:
    """Layer by layer: the blocks of a vector meet the blocks of the matrix, a group
    holding one block and about ``GROUP_ROWS`` vectors; the products of a vector are
    added in order of the blocks."""
    spark = df.sparkSession
    path = scratch_path(spark, "vectors")
    df.withColumn("_lf_r", F.monotonically_increasing_id()).write.parquet(path)
    keyed = spark.read.parquet(path)
    salts = max(1, -(-keyed.count() // GROUP_ROWS))
    layers = [r.layer for r in model.select("layer").distinct().orderBy("layer").collect()]

    def multiply(x: pa.Table, m: pa.Table) -> pa.Table:
        if not x.num_rows or not m.num_rows:
            return product.empty_table()
        block = m.slice(0, 1).to_pylist()[0]
        w = np.array(block["weights"]).reshape(-1, block["width"])
        got = _matrix(x["x"].combine_chunks(), len(w)) @ w
        if block["bias"] is not None:
            got = got + np.array(block["bias"])
        ends = pa.array(np.arange(len(got) + 1, dtype=np.int32) * block["width"])
        values = pa.ListArray.from_arrays(ends, pa.array(got.ravel()))
        return pa.table([x["r"], x["block"], values], schema=product)

    product = pa.schema([("r", pa.int64()), ("block", pa.int32()), ("y", pa.list_(pa.float64()))])
    now = keyed.where(F.col(features).isNotNull()).select(
        F.col("_lf_r").alias("r"), F.col(features).cast("array<double>").alias("x"))
    for i, layer in enumerate(layers):
        mine = model.where(F.col("layer") == layer)
        inputs = F.broadcast(mine.select("block", "first", (F.size("weights") / F.col("width")).cast("int").alias("size"))
                             .agg(F.collect_list(F.struct("block", "first", "size")).alias("cut")))  # one row
        cut = now.join(inputs).select("r", "x", F.explode("cut").alias("c"))
        pieces = cut.select("r", F.col("c.block").alias("block"), F.slice("x", F.col("c.first") + 1, F.col("c.size")).alias("x"),
                            F.pmod(F.xxhash64("r"), F.lit(salts)).cast("int").alias("salt"))
        copies = mine.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = ["block", "salt"]
        parts = pieces.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(
            multiply, "r bigint, block int, y array<double>")
        listed = F.array_sort(F.collect_list(F.struct("block", "y")))
        added = F.aggregate(F.slice(listed, 2, F.size(listed)), F.get(listed, F.lit(0))["y"],
                            lambda acc, p: F.zip_with(acc, p["y"], lambda a, b: a + b))
        summed = parts.groupBy("r").agg(added.alias("x"))
        now = summed if i == len(layers) - 1 else summed.select(
            "r", F.transform("x", lambda v: F.greatest(v, F.lit(0.0))).alias("x"))
    return keyed.join(now.select(F.col("r").alias("_lf_r"), F.col("x").alias(out)), "_lf_r", "left").drop("_lf_r")


def apply_network(df: DataFrame, model: DataFrame, features: str, out: str = "logits",
                  max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """Add the outputs of the last layer (null without a vector).  The size of the
    model table is counted first and decides how it travels."""
    size = model.agg(F.sum(F.size("weights") + F.greatest(F.size("bias"), F.lit(0)))).first()[0] or 0
    if size <= max_shipped:
        return _shipped(df, _gathered(model), features, out)
    return _blockwise(df, model, features, out)
