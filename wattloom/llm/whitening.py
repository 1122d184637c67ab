"""Operator 12: embedding whitening by a randomised range finder.

Entries become integers x = floor(64 c) + 1000000, so that sums over any number of rows are exact.
A random start of k + oversample directions goes through power passes, each one pass over all centred
rows that adds up V Q in the tasks; a Rayleigh-Ritz step in the space found gives eigenvalues and
components, and the residuals |V u - e u| say whether they are good to double precision.  Where they
are not (a flat spectrum has no gap to converge on), the space is expanded to all dimensions, where
Rayleigh-Ritz is exact.  The driver holds matrices of the dimension only, never rows.

Odd input: vectors that are null or hold a null or non-finite entry go, as do vectors of another
length than the commonest (of equally common ones the longest); 64 c is held within 2^44 either way;
components without variance (equal rows, a single row) can't be scaled and have no rows; `deviation`
is null where it passes a long; repeated rows and ids each keep their rows; empty tables give none.
The rows are read once a pass, six to eight times: store an expensive input first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**44
COMPONENTS, OVERSAMPLE, PASSES = 32, 10, 2
ROTATION = 1e-11  # residual over the distance to the next eigenvalue: how far a component may be off
BLOCK_ROWS = 4_096
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"


@dataclass
class Fit:
    """What the rows' sums say: exact per-dimension sums, and a whole number near each mean."""

    n: int
    sums: list[int]

    @property
    def near(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """Sums of x - near: 0 to n - 1."""
        return np.array([s % self.n for s in self.sums], np.int64)


def _vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that stay, all of one length."""
    all_rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    kept = all_rows.where(F.col("v").isNotNull() & whole)
    lengths = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return kept.where(F.size("v") == (lengths[0].d if lengths else 0))


def _numbers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """x of a batch's vectors."""
    c = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(np.clip(SCALE * c, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def _sums(vectors: DataFrame, d: int) -> Fit:
    """n and the exact sums: each task adds whole numbers and hands on their upper and lower 32 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _numbers(batch, d)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": [n] * d, "high": [s >> 32 for s in total], "low": [s & 0xFFFFFFFF for s in total]})

    parts = vectors.mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")))
    found = sorted(parts.collect())
    return Fit(found[0].n, [(r.high << 32) + r.low for r in found]) if found else Fit(0, [])


def _centred(x: np.ndarray, fit: Fit, near: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - near).astype(np.float64) - rest / fit.n


def _total(vectors: DataFrame, fit: Fit, kernel: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over blocks of centred rows of kernel(block), added up in the tasks and then by Spark."""
    d, near, rest, size = len(fit.sums), fit.near, fit.rest, int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = _numbers(batch, d)
            for at in range(0, len(x), BLOCK_ROWS):
                total += kernel(_centred(x[at : at + BLOCK_ROWS], fit, near, rest)).ravel()
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size, dtype=np.int32)), "value": total})

    parts = vectors.mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for r in parts.collect():
        out[r.i] = r.value
    return out.reshape(shape)


def range_finder(times_v: Callable[[np.ndarray], np.ndarray], d: int, k: int, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix that is known by its
    products, the first k, and the size of the space that was good enough."""
    random = np.random.default_rng(seed)
    size = min(d, k + oversample)
    q = np.linalg.qr(random.standard_normal((d, size)))[0]
    for _ in range(passes if size < d else 0):
        q = np.linalg.qr(times_v(q))[0]
    while True:
        z = times_v(q)
        small = q.T @ z
        e, w = np.linalg.eigh((small + small.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        u = q @ w
        residual = np.linalg.norm(z @ w - u * e, axis=0)[:k]
        gaps = np.abs(np.diff(e))[:k]
        apart = np.minimum(np.append(gaps, np.inf)[:k], np.append(np.inf, gaps)[:k])
        if size == d or (residual <= ROTATION * apart).all():
            return e[:k], u[:, :k], size
        q = np.linalg.qr(np.hstack([q, random.standard_normal((d, d - size))]))[0]
        size = d


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """A row for every vector that stays and component: (vec_id, component, n, deviation, whitened,
    explained, identity_error, eigenvalue)."""
    spark = rows.sparkSession
    vectors = _vectors(rows, vec_id, vector)
    probe = vectors.select(F.size("v").alias("d")).take(1)
    d = probe[0].d if probe else 0
    fit = _sums(vectors, d) if d else Fit(0, [])
    if not fit.n:
        return spark.createDataFrame([], SCHEMA)
    n, near, rest = fit.n, fit.near, fit.rest
    trace = float(_total(vectors, fit, lambda a: np.array([(a * a).sum()]), (1,))[0]) / n
    times_v = lambda q: _total(vectors, fit, lambda a: a.T @ (a @ q), (d, q.shape[1])) / n
    e, u, _ = range_finder(times_v, d, min(components, d), oversample, passes)
    kept = e > d * np.finfo(float).eps * max(float(e[0]), 0.0)
    e, u = e[kept], u[:, kept]
    if not len(e):
        return spark.createDataFrame([], SCHEMA)
    scaled, k = u / np.sqrt(e), len(e)
    mean = _total(vectors, fit, lambda a: (a @ scaled).sum(axis=0), (k,)) / n
    product = lambda a: (w := a @ scaled - mean).T @ w
    error = float(np.abs(_total(vectors, fit, product, (k, k)) / n - np.eye(k)).max())
    explained = e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = batch.column(0), _numbers(batch, d)
            for at in range(0, len(numbers), BLOCK_ROWS):
                x = numbers[at : at + BLOCK_ROWS]
                m = len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.slice(at, m).take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, n, np.int64)),
                    "deviation": _deviations(x, n, near, rest).take(pa.array(each)), "whitened": (_centred(x, fit, near, rest) @ scaled).ravel(),
                    "explained": np.tile(explained, m), "identity_error": np.full(m * k, error), "eigenvalue": np.tile(e, m),
                })

    return vectors.mapInArrow(run, SCHEMA)


def _deviations(x: np.ndarray, n: int, near: np.ndarray, rest: np.ndarray) -> pa.Array:
    """The exact sum over dimensions of (n x - S)^2 for each row, null where it passes a long.  A float
    tells the rows that are surely within or beyond; whole numbers of any size decide between."""
    off = x - near
    about = ((off * float(n) - rest) ** 2).sum(axis=1)
    small = about < 2.0**62
    y = np.where(small[:, None], off, 0) * n - rest
    exact = (y * y).sum(axis=1)
    out = [int(v) if s else None for v, s in zip(exact, small)]
    for i in np.flatnonzero(~small & (about < 2.0**64)).tolist():
        v = sum((n * int(o) - int(r)) ** 2 for o, r in zip(off[i], rest))
        out[i] = v if v < 2**63 else None
    return pa.array(out, pa.int64())
