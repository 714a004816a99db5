"""Embedding whitening with a bit-sliced scatter matrix.

Entries become integers (``floor(1024 c) + 100000``).  A task takes some thousand
rows, shifts every dimension to start at 0 and packs each of its bit planes across
the rows into 64-bit words.  The product of two planes is the count of bits in
their AND, so ``sum x_i x_j`` is a weighted sum of such counts: exact, whatever the
order of rows and tasks.  Spark adds the products of all tasks as decimals; they
are centred as integers (``n sum x_i x_j - S_i S_j``) before the first rounding,
and the eigenvectors of that matrix whiten the rows.

Edge cases: a null vector, or one with a null or non-finite entry, is dropped;
repeated rows and null or repeated ids are rows of their own; an empty table gives
no rows.  Vectors have one length; should lengths differ, the most frequent one
(the longer of equals) is taken and the others are dropped.  Entries beyond
+-2^42 are taken as that.  A component whose eigenvalue is 0 to double precision
can't be scaled: its ``whitened`` is null and it doesn't enter ``identity_error``
(0 if there is none).  ``explained`` is null if all rows are equal.  ``deviation``
is null where it passes 64 bits; ``deviation_exact`` holds 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
ROWS = 8192             # rows sliced at once
LIMIT = float(1 << 42)  # of an entry
_SUMS = "i int, j int, s decimal(38,0)"


def valid(vector: str) -> Column:
    """Not null and without null or non-finite entries."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, finite)


def vectors(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows to fit, as (vec_id, vector), and their number of dimensions."""
    kept = df.where(valid(vector)).select("vec_id", F.col(vector).cast("array<double>").alias("vector"))
    lengths = kept.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = lengths[0].d if lengths else 0
    return kept.where(F.size("vector") == dims), dims


def _integers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """Entries as integers less ``SHIFT``, one row a vector."""
    c = np.asarray(batch["vector"].flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    return np.floor(SCALE * np.clip(c, -LIMIT, LIMIT)).astype(np.int64)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, dimension of each, bit of each) of non-negative integers; a plane is
    a row of 64-bit words over the rows of ``y``."""
    bits = [max(1, int(v).bit_length()) for v in y.max(axis=0)]
    dim = np.repeat(np.arange(y.shape[1]), bits)
    bit = np.concatenate([np.arange(b) for b in bits])
    padded = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), np.int64)
    padded[:len(y)] = y
    planes = np.empty((len(dim), len(padded) // 8), np.uint8)
    for p, (d, b) in enumerate(zip(dim, bit)):
        planes[p] = np.packbits((padded[:, d] >> b) & 1)
    return planes.view(np.uint64), dim, bit


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (sums, sums of products) of the columns of integers, as Python ints."""
    low = x.min(axis=0)
    planes, dim, bit = bit_planes(x - low)
    rows, dims = x.shape
    weight = np.array([1 << int(b) for b in bit], object)
    sums = np.zeros(dims, object)
    np.add.at(sums, dim, weight * np.bitwise_count(planes).sum(axis=1).astype(np.int64).astype(object))
    small = 2 * (int(bit.max()) + 1) + rows.bit_length() < 63
    kind = np.int64 if small else object
    at = np.flatnonzero(np.diff(dim, prepend=-1))
    out = np.zeros((dims, dims), object)
    for p, (d, b) in enumerate(zip(dim, bit)):
        counts = np.bitwise_count(planes[p] & planes).sum(axis=1).astype(np.int64).astype(kind)
        out[d] += (np.add.reduceat(counts * weight.astype(kind), at) * kind(1 << int(b)) if small
                   else np.add.reduceat(counts * weight, at) * (1 << int(b))).astype(object)
    base = low.astype(object)
    out = out + np.outer(sums, base) + np.outer(base, sums) + rows * np.outer(base, base)
    return sums + rows * base, out


def _emit(sums: np.ndarray, products: np.ndarray, rows: int) -> pa.RecordBatch:
    """Rows (i, j, s): products for i <= j, sums under i = -1, the count under i = -2."""
    a, b = np.triu_indices(len(sums))
    i = np.concatenate([[-2], np.full(len(sums), -1), a])
    j = np.concatenate([[0], np.arange(len(sums)), b])
    s = [Decimal(int(v)) for v in (rows, *sums, *products[a, b])]
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                       pa.array(s, pa.decimal128(38, 0))], ["i", "j", "s"])


def scatter(kept: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums S, sums of products) of the integers less ``SHIFT``; what reaches the
    driver has one row for two dimensions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            x = _integers(batch, dims)
            for at in range(0, len(x), ROWS):
                s, p = cross_products(x[at:at + ROWS])
                rows, sums, products = rows + len(x[at:at + ROWS]), sums + s, products + p
        if rows:
            yield _emit(sums, products, rows)

    parts = kept.select("vector").mapInArrow(run, _SUMS).groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    n, sums, products = 0, [0] * dims, [[0] * dims for _ in range(dims)]
    for r in parts.collect():
        if r.i == -2:
            n = int(r.s)
        elif r.i == -1:
            sums[r.j] = int(r.s)
        else:
            products[r.i][r.j] = products[r.j][r.i] = int(r.s)
    return n, sums, products


def components(n: int, sums: list[int], products: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvectors as columns, their eigenvalues, trace) of the covariance, by
    falling eigenvalue."""
    dims = range(len(sums))
    cov = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in dims] for i in dims])
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    return vecs[:, order], values[order], float(np.trace(cov))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: int64 where that fits, Python ints beyond."""
    if (int(np.abs(x).max(initial=0)) + 1) * n + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviations(d: np.ndarray) -> list[int]:
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 62:
        return (d * d).sum(axis=1).tolist()
    d = d.astype(object)
    return [int(v) for v in (d * d).sum(axis=1)]


def whiten(df: DataFrame, vector: str = "embedding", most: int = 8) -> DataFrame:
    """One row for every valid vector and component: vec_id, component, n,
    deviation, whitened, explained, identity_error, deviation_exact.

    Three scans: the scatter matrix, the covariance of what was whitened (measured
    on the rows, not derived), and the result."""
    id_type = df.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double, deviation_exact decimal(38,0)")
    kept, dims = vectors(df, vector)
    n, sums, products = scatter(kept, dims) if dims else (0, [], [])
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    axes, values, trace = components(n, sums, products, most)
    usable = values > dims * np.finfo(float).eps * max(values.max(), 0.0)
    axes = axes * np.where(usable, 1 / np.sqrt(np.where(usable, values, 1.0)), 0.0)
    shown = [float(max(v, 0.0)) / trace if trace > 0 else None for v in values]

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centred = _centred(x, n, sums)
        return centred, (centred / n).astype(np.float64) @ axes

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = axes.shape[1]
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = project(_integers(batch, dims))[1]
            w = np.column_stack([w, np.ones(len(w))])
            total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    measured = kept.select("vector").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    second = np.zeros((axes.shape[1] + 1,) * 2)
    for r in measured.collect():
        second[r.i, r.j] = r.s
    mean = second[:-1, -1] / n
    off = second[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))
    error = float(np.abs(off[np.ix_(usable, usable)]).max(initial=0.0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = axes.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                centred, w = project(_integers(part, dims))
                size, exact = part.num_rows, _deviations(centred)
                every = pa.array(np.repeat(np.arange(size), k))
                yield pa.RecordBatch.from_arrays([
                    part["vec_id"].take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, n, np.int64)),
                    pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(every),
                    pa.array(w.ravel(), mask=np.tile(~usable, size)), pa.array(shown * size, pa.float64()),
                    pa.array(np.full(size * k, error)),
                    pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0)).take(every)],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return kept.mapInArrow(rows, schema)
