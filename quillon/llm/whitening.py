"""Embedding whitening by refined eigenvectors of an exact distributed covariance.

Entries become whole numbers, so sums and products are exact: tasks multiply
blocks of rows, centred by the rounded mean, with sums below 2^53 in float64, and
add the blocks up as integers. The covariance then has no error but the last
rounding. Its eigenvectors are found in float32 and corrected in extended
precision by the iteration of Ogita and Aishima, which is matrix products alone
and doubles the right digits at each step; eigenvectors whose eigenvalues lie
closer than what the present error can tell apart are turned among themselves by
an eigensolve of their own shifted block.

Only sums of the size of the dimension, or its square, reach the driver.

Defined results: rows whose vector is null or empty, has null or non-finite entries, or
has another length than most vectors (the longer of two equally common ones) are
left out; repeated rows are listed each, while the fit takes each vector once;
components whose eigenvalue is not above 1e-12 of all variance have no rows, so a
single distinct vector gives none; a deviation of over 63 bits is null; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from quillon.llm.common import bounded_batches, materialize

#: Eigenvalues below this share of all variance count as zero.
LEAST_SHARE = 1e-12
LIMB, LIMBS = (1 << 40) - 1, ("p0", "p1", "p2", "p3")
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# Eigenvectors ---------------------------------------------------------------


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of values in runs whose neighbours, in order, lie within gap."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One correction of approximate eigenvectors x of a: eigenvalues, better vectors, size of the change, gap below which eigenvalues can't be told apart."""
    off, s = np.eye(len(a), dtype=a.dtype) - x.T @ x, x.T @ (a @ x)
    off, s = (off + off.T) / 2, (s + s.T) / 2  # else rounding, divided by small gaps, would make vectors oblique
    values = np.diag(s) / (1 - np.diag(off))
    gap = 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(off.astype(float)))
    apart = values[None, :] - values[:, None]
    told = np.abs(apart) > gap
    change = np.where(told, (s + values[None, :] * off) / np.where(told, apart, 1), off / 2)
    return values, x + x @ change, float(np.abs(change).max()), gap


def eigenvectors(a: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of a symmetric matrix and their unit vectors as columns, in the precision of a; the largest entry of a vector is positive."""
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(len(a), a.dtype), np.eye(len(a), dtype=a.dtype)
    a, least, last = a / scale, 64 * len(a) * np.finfo(a.dtype).eps, np.inf
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(a.dtype)
    for _ in range(rounds):
        values, x, moved, gap = refine(a, x)
        for own in _clusters(values.astype(float), gap):
            # What tells these vectors apart is small beside their eigenvalue, so it is solved for without it.
            middle = values[own].mean()
            block = x[:, own].T @ (a @ x[:, own] - middle * x[:, own])
            block = (block + block.T) / 2
            size = np.abs(block).max()
            if size > least:
                turn = np.linalg.eigh((block / size).astype(float))[1].astype(a.dtype)
                x[:, own] = x[:, own] @ (1.5 * turn - 0.5 * turn @ (turn.T @ turn))
        if moved < least or moved < 1e-10 and moved > last / 4:
            break
        last = moved
    values, x, _, _ = refine(a, x)
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    return values * scale, x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])


# Sums over tasks ------------------------------------------------------------


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy().reshape(-1, dims)


def _moments(dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each dimension count, sum in limbs, least and largest."""
    n, total, low, high = 0, np.zeros(dims, object), None, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, dims)
            n += len(x)
            total += (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & 0x7FFFFFFF).sum(axis=0).astype(object)
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
    if n:
        parts = [np.arange(dims), np.full(dims, n), *_limbs(total), low, high]
        yield pa.record_batch([pa.array(p.astype(np.int64)) for p in parts], ["i", "n", *LIMBS, "low", "high"])


def _limbs(whole: np.ndarray) -> list[np.ndarray]:
    """Integers of up to 180 bits as longs of 40 bits each, lowest first; the last has the sign. Their sums can be taken one by one."""
    return [*[(whole >> at & LIMB).astype(np.int64) for at in (0, 40, 80)], (whole >> 120).astype(np.int64)]


def _whole(row: Row) -> int:
    return sum(row[c] << 40 * at for at, c in enumerate(LIMBS))


def gram(z: np.ndarray, largest: int) -> np.ndarray:
    """z' z as exact integers; largest bounds all |z|."""
    room = (1 << 53) // max(1, largest * largest)
    if not room:
        z = z.astype(object)
        return z.T @ z
    out = np.zeros((z.shape[1], z.shape[1]), object)
    for at in range(0, len(z), min(room, 1 << 14)):
        part = z[at : at + min(room, 1 << 14)].astype(float)
        out += (part.T @ part).astype(np.int64)
    return out


def _products(dims: int, centre: np.ndarray, largest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, upper = np.zeros((dims, dims), object), np.triu_indices(dims)
    for batch in batches:
        if batch.num_rows:
            total += gram(_matrix(batch, dims) - centre, largest)
    if total.any():
        parts = [*upper, *_limbs(total[upper])]
        yield pa.record_batch([pa.array(p.astype(np.int64)) for p in parts], ["i", "j", *LIMBS])


@dataclass(frozen=True)
class Whitening:
    """What is fitted: count, sums, rounded mean, its distance to the mean, weights of the components, eigenvalues, all variance."""

    n: int
    sums: list[int]
    centre: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    values: np.ndarray
    variance: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.shift) @ self.weights

    def deviations(self, x: np.ndarray) -> np.ndarray | list[int | None]:
        """Sums of (n*x - sum)^2 as exact integers."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums))
        if most * most * x.shape[1] < 1 << 63:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1)
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def _extended(whole: int) -> np.longdouble:
    high = float(whole)
    return np.longdouble(high) + np.longdouble(float(whole - int(high)))


def fit_whitening(vectors: DataFrame, dims: int, components: int) -> Whitening | None:
    """Fit on the rows of vectors (column x, arrays of dims longs; a table that is cheap to read). None for an empty table."""
    sums = vectors.mapInArrow(partial(_moments, dims), ", ".join(f"{c} long" for c in ("i", "n", *LIMBS, "low", "high"))).groupBy("i")
    found = sorted(sums.agg(*[F.sum(c).alias(c) for c in ("n", *LIMBS)], F.min("low").alias("low"), F.max("high").alias("high")).collect())
    if not found:
        return None
    n, total = found[0]["n"], [_whole(r) for r in found]
    middle = [(2 * s + n) // (2 * n) for s in total]
    largest = max(max(abs(r["low"] - m), abs(r["high"] - m)) for r, m in zip(found, middle, strict=True))
    centre = np.array(middle, np.int64)
    made = vectors.mapInArrow(partial(_products, dims, centre, largest), ", ".join(f"{c} long" for c in ("i", "j", *LIMBS))).groupBy("i", "j")
    products = np.zeros((dims, dims), object)
    for r in made.agg(*[F.sum(c).alias(c) for c in LIMBS]).collect():
        products[r["i"], r["j"]] = products[r["j"], r["i"]] = _whole(r)
    left = np.array([s - n * m for s, m in zip(total, middle, strict=True)], object)
    exact = products * n - np.outer(left, left)
    covariance = np.array([[_extended(v) for v in row] for row in exact], np.longdouble).reshape(dims, dims) / _extended(n * n)
    values, x = eigenvectors(covariance)
    variance = np.trace(covariance)
    k = int((values[:components] > LEAST_SHARE * variance).sum()) if variance > 0 else 0
    weights = (x[:, :k] / np.sqrt(values[:k])).astype(float)
    shift = np.array([float(_extended(v) / _extended(n)) for v in left])
    return Whitening(n, total, centre, shift, weights, values[:k].astype(float), float(variance))


def _whitened_products(model: Whitening, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of whitened components; the last row and column hold their own sums."""
    k = model.weights.shape[1] + 1
    total = np.zeros((k, k))
    for batch in batches:
        w = model.project(_matrix(batch, len(model.sums)))
        w = np.hstack([w, np.ones((len(w), 1))])
        total += w.T @ w
    i, j = np.indices((k, k)).reshape(2, -1)
    yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of them."""
    k = model.weights.shape[1]
    total = np.zeros((k + 1, k + 1))
    for r in vectors.mapInArrow(partial(_whitened_products, model), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    mean = total[k, :k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten_embeddings(
    rows: DataFrame, *, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each usable row and component.

    An entry c counts as floor(scale * c) + offset; the offset changes no result
    and is left out of all sums.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    usable = F.coalesce(F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))
    own = rows.filter(usable & (F.size(v) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x"))
    size = own.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], WHITENED)
    if size is None:
        return empty
    dims = size["d"]
    own = own.filter(F.size("x") == dims)
    distinct = materialize(own.select("x").distinct(), "whitening-fit")
    model = fit_whitening(distinct, dims, components)
    if model is None or not model.weights.shape[1]:
        return empty
    error, k = identity_error(distinct, model), model.weights.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dims)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            deviation = pa.array(model.deviations(x), pa.int64())
            explained = model.values / model.variance
            columns = [
                batch["vec_id"].take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n)), deviation.take(each),
                pa.array(model.project(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.record_batch(columns, [c.split()[0] for c in WHITENED.split(", ")])

    return own.mapInArrow(project, WHITENED)
