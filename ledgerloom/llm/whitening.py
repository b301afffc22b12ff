"""Whitening of embeddings with components found by QDWH spectral divide and conquer.

Entries are fixed-point numbers floor(256 c). The mean and covariance are those of the distinct vectors, so copies weigh once. The covariance, dimensions by dimensions, is the only thing that
reaches the driver. There it is split: the polar factor of the covariance less a shift, computed by the dynamically weighted Halley iteration, is +1 on the
eigenvectors above the shift and -1 on those below; (U + I) / 2 projects on the first. Bases of both subspaces cut the covariance into
two smaller ones, and so on down to single components; parts below the wanted ones are left whole. The projection, dimensions by components,
goes to every task, and rows are whitened where they are.

The distinct vectors are written below the shared folder and read for the sums, the covariance about the mean, and the check that the whitened
ones have the identity as covariance.

Defined results: null vectors and vectors with a null, NaN or infinite entry are left out, as are empty vectors and those whose length is not the most
common one among distinct vectors (ties: the longer). Repeated rows and ids give a row each. A component without variance (relative to the largest, below
dimensions x 2^-48) can't be whitened: its `whitened` is null, `explained` is 0 and the check leaves it out; identity_error is null if none is left. Entries
beyond 2^63 / 256 become the nearest long. A `deviation` beyond 2^63 is null. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.workspace import run_folder

EPS = float(np.finfo(float).eps)
BLOCK = 4096


# Spectral divide and conquer.


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH steps."""
    n, scale = len(a), np.linalg.norm(a)
    x, eye, low = a / scale, np.eye(len(a)), EPS / 4  # a lower bound of the singular values, or of those that matter
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square ** 2)
        wide = np.sqrt(1 + d)
        wa = wide + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * wide))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        after = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        moved, x = np.linalg.norm(after - x), after
        if moved < np.cbrt(10 * EPS) and 1 - low < 10 * EPS:
            break
    return x


def _bases(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of the rest: one step of subspace iteration from its longest columns."""
    longest = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
    start = projector[:, longest[:min(len(projector), rank + 3)]]
    q, _ = np.linalg.qr(start @ np.random.default_rng(5).standard_normal((start.shape[1], rank)))
    q, _ = np.linalg.qr(projector @ q)
    whole, _ = np.linalg.qr(np.hstack([q, np.eye(len(projector))]))
    return whole[:, :rank], whole[:, rank:]


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the subspaces above and below a shift; None if all eigenvalues are the same to rounding."""
    n, size = len(a), np.linalg.norm(a)
    diagonal = np.diag(a)
    if np.linalg.norm(a - np.trace(a) / n * np.eye(n)) <= 4 * n * EPS * size:
        return None
    mean, spread = float(diagonal.mean()), float(np.ptp(diagonal)) or size
    best = None
    for shift in (float(np.median(diagonal)), mean, mean + spread / 7, mean - spread / 7, mean + spread / 61):
        u = polar_factor(a - shift * np.eye(n))
        projector = (u + np.eye(n)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        high, low = _bases(projector, rank)
        left = np.linalg.norm(low.T @ a @ high)  # what a true split leaves is rounding
        if best is None or left < best[0]:
            best = left, high, low
        if left <= 16 * n * EPS * size:
            break
    return None if best is None else best[1:]  # no shift parts eigenvalues that are one to rounding


def components_of(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    n = len(a)
    wanted = min(wanted, n)
    if not wanted:
        return np.zeros(0), np.zeros((n, 0))
    parts = None if n == 1 else _split(a)
    if parts is None:
        values, vectors = np.diag(a).copy(), np.eye(n)
    else:
        values, vectors, left = [], [], wanted
        for basis in parts:
            if left:
                inner = basis.T @ a @ basis
                v, w = components_of((inner + inner.T) / 2, left)
                values, vectors, left = [*values, v], [*vectors, basis @ w], left - len(v)
        values, vectors = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


# Sums over distinct vectors.


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def valid(vector: Column) -> Column:
    """True for vectors with at least one entry and only finite ones."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda c: F.coalesce(
        ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))), F.lit(False))


def fixed_point(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 256) + F.lit(0).cast("long"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each dimension's high and low halves, which a long holds for 2^31 vectors a task."""
    high = low = None
    for batch in batches:
        x = _matrix(batch.column("x"))
        if len(x):
            high = (x >> 32).sum(axis=0) + (0 if high is None else high)
            low = (x & 0xFFFFFFFF).sum(axis=0) + (0 if low is None else low)
    if high is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(high), pa.array(low)], ["dim", "high", "low"])


def _triangle(matrix: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(matrix))
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(matrix[i, j])], ["i", "j", "v"])


def _centred(x: np.ndarray, mean: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x less the mean, which is a whole part and a rest below 1."""
    near = np.abs(x) < 1 << 61
    whole = np.where(near, x, 0) - np.where(np.abs(mean) < 1 << 61, mean, 0)
    far = np.where(near, 0.0, x.astype(float)) - np.where(np.abs(mean) < 1 << 61, 0.0, mean.astype(float))
    return whole + far - rest


def _products(mean: np.ndarray, rest: np.ndarray, projection: np.ndarray | None = None):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                y = _centred(_matrix(batch.column("x").slice(at, BLOCK)), mean, rest)
                y = y if projection is None else y @ projection
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            yield _triangle(total)

    return add


def _summed(fit: DataFrame, add, size: int, n: int) -> np.ndarray:
    """The products of all tasks, added up on Spark; size * (size + 1) / 2 numbers reach the driver."""
    rows = fit.mapInArrow(add, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out, (i, j, v) = np.zeros((size, size)), (rows[c].to_numpy() for c in "ijv")
    out[i, j] = out[j, i] = v / n
    return out


@dataclass
class Whitening:
    """n distinct vectors with exact sums, and the projection. Its size follows from the dimensions and components."""

    n: int
    sums: list[int]
    projection: np.ndarray  # dimensions by components, already over sqrt(e); 0 for components without variance
    explained: np.ndarray
    alive: np.ndarray
    identity_error: float | None

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        return _mean(self.sums, self.n)


def _mean(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    whole = [s // n for s in sums]
    return np.array(whole, dtype=np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """From the valid vectors, one column x of long arrays; None if there are none."""
    spark = vectors.sparkSession
    at = run_folder(spark, "whitening")
    vectors.select("x").distinct().withColumn("size", F.size("x")).write.parquet(at)
    stored = spark.read.parquet(at)
    most = stored.groupBy("size").count().orderBy(F.col("count").desc(), F.col("size").desc()).head()
    if most is None:
        return None
    size, n = most
    rows = stored.where(F.col("size") == size).select("x")
    found = (rows.mapInArrow(_sums, "dim long, high long, low long").groupBy("dim")
             .agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect())
    sums = [0] * size
    for r in found:
        sums[r["dim"]] = (int(r["high"]) << 32) + int(r["low"])
    mean = _mean(sums, n)
    covariance = _summed(rows, _products(*mean), size, n)
    values, vectors_ = components_of(covariance, components)
    trace = float(np.trace(covariance))
    alive = values > max(values[0], 0) * size * 2.0 ** -48
    projection = np.where(alive, vectors_ / np.sqrt(np.where(alive, values, 1)), 0)
    error = None
    if alive.any():
        whitened = _summed(rows, _products(*mean, projection), len(values), n)
        error = float(np.abs(whitened - np.eye(len(values)))[np.ix_(alive, alive)].max())
    return Whitening(n, sums, projection, np.where(alive, values / (trace or 1), 0), alive, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exactly; null beyond a long."""
    largest = n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums))
    if largest * largest * x.shape[1] < 2.0 ** 62:
        y = x * n - np.array(sums)
        return pa.array((y * y).sum(axis=1))
    found = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return pa.array([f if f < 1 << 63 else None for f in found], type=pa.int64())


def _whitened(model: Whitening):
    mean, rest = model.mean()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column("x"))
                z, deviation = _centred(x, mean, rest) @ model.projection, _deviations(x, model.n, model.sums)
                for k, alive in enumerate(model.alive):
                    whitened = pa.array(z[:, k]) if alive else pa.nulls(len(x), pa.float64())
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.full(len(x), k + 1, dtype=np.int32)), deviation, whitened],
                                                     ["id", "component", "deviation", "whitened"])

    return rows


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """For each valid row and component: the key, component, n, deviation, whitened, explained, identity_error."""
    kind = rows.schema[key].dataType.simpleString()
    entries = rows.where(valid(F.col(vector))).select(F.col(key).alias("id"), fixed_point(F.col(vector)).alias("x"))
    model = fit(entries, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    usable = entries.where(F.size("x") == len(model.sums))
    found = usable.mapInArrow(_whitened(model), f"id {kind}, component int, deviation long, whitened double")
    explained = F.element_at(F.array(*[F.lit(float(e)) for e in model.explained]), F.col("component"))
    return found.select(F.col("id").alias(key), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                        explained.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
