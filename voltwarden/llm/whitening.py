"""Whitening of embeddings by matrix-free block subspace iteration.

Entries become whole numbers, so sums and centres are exact. The covariance is never formed: each pass over the distinct
vectors computes X'(XQ) of their centred rows for a block Q of orthonormal columns. The driver orthonormalises by QR,
rotates the block by Rayleigh-Ritz, and goes on until the residuals of all wanted components certify them. Where the block
is narrower than the vectors, passes between two Rayleigh-Ritz steps apply a Chebyshev polynomial of the covariance, which
damps all that lies below the block's smallest value; where it is as wide, the first pass spans everything.

What the driver and each task hold is a few blocks: the vectors' length times the block's width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Columns of the block for each component wanted; residual, as a share of the largest eigenvalue, that certifies one;
#: residual that is good enough where rounding lets it fall no further; share of the largest eigenvalue below which a
#: component has no variance; passes in all at most.
WIDE, CERTIFIED, ROUNDED, NOTHING, PASSES = 4, 1e-13, 1e-10, 1e-12, 2000
#: Entries are kept within this, so that sums of two stay longs.
LARGEST = 1 << 61


def whole(embedding: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each entry c; beyond 2^61 the floor is 2^61."""
    return F.transform(embedding, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(c.cast("double") * scale))) + shift)


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, x: the rows whose vector holds only finite entries, as whole numbers."""
    e = F.col(embedding)
    sound = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    given = df.where(e.isNotNull()).where(F.coalesce(sound, F.lit(False)))
    return given.select(F.col(vec_id).cast("long").alias("vec_id"), whole(e, scale, shift).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Centre:
    """The mean of n vectors of whole numbers, exactly: low + rest / n."""

    n: int
    low: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """The sum over dimensions of (n * x - S)^2 of each row, exact."""
        far = x - self.low
        most = int(np.abs(far).max(initial=0)) * self.n + self.n
        if x.shape[1] * most * most < 1 << 63:
            y = far * self.n - self.rest
            return (y * y).sum(axis=1)
        y = far.astype(object) * self.n - self.rest.astype(object)
        return (y * y).sum(axis=1).tolist()


def centre(fit: DataFrame, d: int) -> Centre:
    """The centre of a table of vectors x: sums by task, added up by dimension; the driver gets one row a dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in common.slices(batches):
            x = matrix(b.column(0), d)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    by_task = fit.select("x").mapInArrow(sums, "i long, n long, high long, low long")
    rows = by_task.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()  # d rows
    n = int(rows[0].n) if rows else 0
    total = [(int(r.high) << 32) + int(r.low) for r in rows]
    return Centre(n, np.array([s // n for s in total] if n else [0] * d, np.int64), np.array([s % n for s in total] if n else [0] * d, np.int64))


def gathered(fit: DataFrame, d: int, parts: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """The sums over all vectors of the matrices that parts(x) gives for some of them; the driver gets their entries once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in common.slices(batches):
            own = parts(matrix(b.column(0), d))
            total = own if total is None else [t + o for t, o in zip(total, own)]
        if total is not None:
            flat = np.concatenate([t.ravel() for t in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    shapes = [m.shape for m in parts(np.zeros((0, d), np.int64))]
    flat = np.zeros(sum(int(np.prod(s)) for s in shapes))
    for r in fit.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
        flat[r.i] = r.v
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [flat[e - int(np.prod(s)) : e].reshape(s) for s, e in zip(shapes, ends)]


@dataclass
class Found:
    values: np.ndarray  # eigenvalues, falling
    columns: np.ndarray  # their unit eigenvectors
    passes: int
    residual: float  # the largest, as a share of the first eigenvalue


def subspace(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int | None = None, seed: int = 1) -> Found:
    """The k leading eigenpairs of the positive semidefinite matrix that `multiply` applies to a block of d rows.

    Those without variance are left out. A pass is one call; every one but those of the Chebyshev filter ends in a
    Rayleigh-Ritz step, whose residuals either certify all pairs or start the next round.
    """
    p = min(d, max(k, block or WIDE * k))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, p)))[0]
    passes, before, slow = 0, np.inf, 0
    while True:
        y = multiply(q)
        passes += 1
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, y = q @ turn, y @ turn
        top = values[0]
        wanted = min(k, int((values > NOTHING * top).sum())) if top > 0 else 0
        worst = float(np.linalg.norm(y[:, :wanted] - x[:, :wanted] * values[:wanted], axis=0).max(initial=0) / top) if wanted else 0.0
        slow = slow + 1 if worst > before / 2 else 0
        if worst <= CERTIFIED or (worst <= ROUNDED and (slow >= 2 or p == d and passes > 1)):
            return Found(values[:wanted], x[:, :wanted], passes, worst)
        if passes >= PASSES:
            raise RuntimeError(f"residual {worst:.1e} after {passes} passes")
        before = worst
        bound = values[-1]
        if p == d or bound <= NOTHING * top or bound >= top:
            q = np.linalg.qr(y)[0]
            continue
        # Chebyshev on [0, bound]; as many passes as let the first column outgrow the last by 1e8
        c = e = bound / 2
        grows = (top - c) / e + np.sqrt(((top - c) / e) ** 2 - 1)
        degree = int(np.clip(np.log(1e8) / np.log(grows), 1, 16))
        first = share = e / (top - c)
        old, new = x, (y - c * x) * (first / e)
        for _ in range(degree - 1):
            after = 1 / (2 / first - share)
            old, new = new, (multiply(new) - c * new) * (2 * after / e) - old * (share * after)
            passes += 1
            share = after
        q = np.linalg.qr(new)[0]


def whiten(df: DataFrame, k: int = 16, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64, shift: int = 1_000_000, block: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual, passes: k rows a vector.

    The fit list is each distinct vector once, n of them. Vectors that are null, or hold a null or an entry that is not
    finite, take no part; nor do those of another length than most have (of two lengths as frequent, the longer one
    counts). Repeated rows, null ids and repeated ids are rows like others. Components without variance are left out,
    so fewer than k come where the vectors span less, none where all are alike, and an empty table has an empty result.
    Where eigenvalues are equal, any orthonormal vectors of their space are components. deviation is a decimal.
    """
    out = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, residual double, passes int"
    sound = vectors(df, vec_id, embedding, scale, shift)
    length = sound.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if length is None or not length.d:
        return df.sparkSession.createDataFrame([], out)
    d = length.d
    rows = sound.where(F.size("x") == d)
    fit = common.written(rows.select("x").distinct(), "fit")
    mean = centre(fit, d)

    def times(q: np.ndarray) -> np.ndarray:
        def parts(x: np.ndarray) -> list[np.ndarray]:
            c = mean.centred(x)
            return [c.T @ (c @ q)]

        return gathered(fit, d, parts)[0] / mean.n

    found = subspace(times, d, k, block)
    own = len(found.values)
    if not own:
        return df.sparkSession.createDataFrame([], out)
    signs = np.sign(found.columns[np.abs(found.columns).argmax(axis=0), np.arange(own)])
    weights = found.columns * signs / np.sqrt(found.values)

    def second(x: np.ndarray) -> list[np.ndarray]:
        c = mean.centred(x)
        z = c @ weights
        return [z.T @ z, z.sum(axis=0), (c * c).sum(axis=(0, 1), keepdims=True)]

    square, total, spread = gathered(fit, d, second)
    error = float(np.abs(square / mean.n - np.outer(total, total) / mean.n**2 - np.eye(own)).max())
    explained = found.values / (spread.item() / mean.n)
    component = np.arange(1, own + 1, dtype=np.int32)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()), ("residual", pa.float64()), ("passes", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            x = matrix(b.column(1), d)
            each = pa.array(np.repeat(np.arange(len(x)), own))
            far = mean.deviations(x)
            far = pa.array(far).cast(pa.decimal128(38, 0)) if isinstance(far, np.ndarray) else pa.array([None if v >= 10**38 else v for v in far], pa.decimal128(38, 0))
            many = len(x) * own
            same = [np.full(many, v) for v in (error, found.residual)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(each), pa.array(np.tile(component, len(x))), pa.array(np.full(many, mean.n)), far.take(each), pa.array((mean.centred(x) @ weights).ravel()), pa.array(np.tile(explained, len(x))), *map(pa.array, same), pa.array(np.full(many, found.passes, np.int32))], schema=schema)

    return rows.mapInArrow(run, out)
