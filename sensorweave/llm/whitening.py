"""Embedding whitening: the leading covariance axes by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.llm.common import discard, stage

#: Entries are used as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Params:
    """``components`` wanted; ``guard`` more directions are iterated beside them. ``degree`` bounds the passes of one
    filter, ``growth`` how far a filter may pull apart the wanted directions, ``passes`` the passes in all.
    A pair is certified when its residual is at most ``tolerance`` times the largest eigenvalue."""

    components: int = 32
    guard: int = 24
    degree: int = 12
    growth: float = 1e8
    passes: int = 400
    tolerance: float = 64 * EPS
    seed: int = 11


class NotCertified(RuntimeError):
    """The wanted axes did not reach the tolerance within the allowed passes."""


@dataclass(frozen=True)
class Axes:
    """``vectors`` (dimension x components), eigenvalues, residual norms and the trace of the covariance of ``n`` rows.

    ``shift`` is the whole part of the mean of each dimension, ``rest`` n times what is left of it, exactly."""

    n: int
    shift: np.ndarray
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part is taken off exactly, before anything is rounded."""
        return (x - self.shift).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over the dimensions of (n*x - S)^2; none where a long does not hold it."""
        y, rest = x - self.shift, np.array(self.rest, dtype=object)
        far = float(np.abs(y).max(initial=0)) + 1
        if (far * self.n) ** 2 * max(y.shape[1], 1) < 2 ** 62:
            return ((y * self.n - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        whole = ((y.astype(object) * self.n - rest) ** 2).sum(axis=1)
        return [v if v < 2 ** 63 else None for v in whole.tolist()]


def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)


def whole_entries(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The columns of ``df`` in ``_row`` and ``x``: each entry c as floor(64 * c) + 1000000.

    Rows whose vector is null or empty, or holds a null, a non-finite entry or one beyond 2^43 (whose long
    would not be exact), are left out; so are vectors of another length than most (of equal shares: the longer).
    """
    c = F.col(f"`{vector}`").cast("array<double>")
    # no null, no NaN (the largest double in Spark's order), nothing out of range
    fine = F.forall(c, lambda v: F.coalesce(F.abs(v) < F.lit(float(2 ** 43)), F.lit(False)))
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + F.lit(OFFSET).cast("long"))
    rows = df.select(F.struct(*[F.col(f"`{k}`") for k in df.columns if k != vector]).alias("_row"), x.alias("x"),
                     (fine & (F.size(c) > 0)).alias("_fine")).where("_fine").drop("_fine")
    return rows


def _summed(rows: DataFrame, make: Callable[[Iterator[np.ndarray]], np.ndarray], dim: int, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all tasks of the array that ``make`` gives for the vectors of a task.

    The cells are added in a shuffle; the driver receives one array, whose size does not grow with the rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = make(_matrix(b, dim) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.size)), pa.array(part.ravel())], names=["cell", "v"])

    cells = rows.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[cells["cell"].to_numpy()] = cells["v"].to_numpy()
    return out.reshape(shape)


def _sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, [0] * dim
        for b in batches:
            x = _matrix(b, dim)
            for at in range(0, len(x), 4096):  # 2^50 each: a long holds the sum of 4,096
                s = [a + int(v) for a, v in zip(s, x[at:at + 4096].sum(axis=0))]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim)), pa.array([str(v) for v in (n, *s)])], names=["i", "v"])

    got = (rows.select("x").mapInArrow(run, "i long, v string").groupBy("i")
           .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())  # one row per dimension
    by = {r.i: int(r.v) for r in got}
    return by.get(-1, 0), [by.get(i, 0) for i in range(dim)]


class _Operator:
    """Passes of the centred covariance over the rows: ``times(Q)`` is (1/n) sum of (x-m)((x-m)'Q)."""

    def __init__(self, rows: DataFrame, n: int, sums: list[int]):
        self.rows, self.n, self.dim, self.passes = rows, n, len(sums), 0
        self.shift = np.array([s // n for s in sums], np.int64)
        self.rest = [s - n * int(o) for s, o in zip(sums, self.shift)]
        self.mean = np.array([r / n for r in self.rest])

    def times(self, q: np.ndarray) -> np.ndarray:
        shift, mean, dim = self.shift, self.mean, self.dim

        def make(parts: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros(q.shape)
            for x in parts:
                z = (x - shift).astype(np.float64) - mean
                out += z.T @ (z @ q)
            return out

        self.passes += 1
        return _summed(self.rows, make, dim, q.shape) / self.n

    def trace(self) -> float:
        shift, mean, dim = self.shift, self.mean, self.dim

        def make(parts: Iterator[np.ndarray]) -> np.ndarray:
            return np.array([sum(float((((x - shift).astype(np.float64) - mean) ** 2).sum()) for x in parts)], np.float64)

        return float(_summed(self.rows, make, dim, (1,))[0]) / self.n


def _gain(t: float) -> float:
    """How much a Chebyshev polynomial grows per degree at ``t`` outside its interval [-1, 1]."""
    return abs(t) + float(np.sqrt(max(t * t - 1, 0.0)))


class _Floor:
    """Lower bound of the spectrum by Lanczos steps that ride along as one more column of each pass.

    The smallest Ritz value less the last residual; zero until there are steps enough. A bound that is too
    high only slows the filter down, since the certificate does not rest on it.
    """

    steps = 12

    def __init__(self, dim: int, rng: np.random.Generator):
        v = rng.standard_normal(dim)
        self.basis, self.alpha, self.beta = [v / np.linalg.norm(v)], [], []

    @property
    def column(self) -> np.ndarray | None:
        return self.basis[-1] if len(self.alpha) < min(self.steps, len(self.basis[0])) else None

    def take(self, image: np.ndarray) -> None:
        v = self.basis[-1]
        self.alpha.append(float(v @ image))
        for _ in range(2):
            for u in self.basis:
                image = image - u * (u @ image)
        b = float(np.linalg.norm(image))
        self.beta.append(b)
        self.basis.append(image / b if b > 1e-12 * abs(self.alpha[0]) else np.zeros_like(image))

    def bound(self) -> float:
        if len(self.alpha) < 3:
            return 0.0
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        value, vector = np.linalg.eigh(t)
        return max(0.0, float(value[0] - self.beta[-1] * abs(vector[-1, 0])))


def axes(rows: DataFrame, p: Params = Params()) -> Axes | None:
    """Leading eigenpairs of the covariance (divisor n) of the vectors ``x``, or none where there are no rows.

    A random orthonormal block is filtered: the polynomial recurrence Y(j+1) = 2 (V - c)/e Y(j) - Y(j-1), one
    pass over the rows per degree, damps all that lies between the smallest eigenvalue and the smallest Ritz
    value of the block. QR and a Rayleigh-Ritz step follow, whose one pass also gives the residuals and the
    first degree of the next filter. It ends when each wanted pair is certified: |V q - e q| within the
    tolerance. Axes whose eigenvalue is rounding noise of the largest are left out, so there may be fewer than
    wanted, and none if all vectors are equal. Memory on the driver: a few dimension x block arrays.
    """
    head = rows.select("x").head(1)
    if not head:
        return None
    dim = len(head[0].x)
    n, sums = _sums(rows, dim)
    v = _Operator(rows, n, sums)
    rng = np.random.default_rng(p.seed)
    k = min(p.components, dim)
    m = min(dim, k + p.guard)
    floor = _Floor(dim, rng)

    def times(y: np.ndarray) -> np.ndarray:
        extra = floor.column
        if extra is None:
            return v.times(y)
        out = v.times(np.column_stack([y, extra]))
        floor.take(out[:, -1])
        return out[:, :-1]

    q = np.linalg.qr(rng.standard_normal((dim, m)))[0]
    trace = v.trace()
    while True:
        image = times(q)
        h = q.T @ image
        value, turn = np.linalg.eigh((h + h.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = max(float(value[0]), 0.0)
        live = int((value[:k] > top * dim * 16 * EPS).sum()) if top > trace * EPS else 0
        residual = np.linalg.norm(image[:, :live] - q[:, :live] * value[:live], axis=0)
        if (residual <= p.tolerance * top).all():
            break
        if v.passes >= p.passes:
            raise NotCertified(f"residual {residual.max():.3g} after {v.passes} passes, wanted {p.tolerance * top:.3g}")
        low, high = min(floor.bound(), float(value[-1]) * (1 - 1e-6)), float(value[-1])
        centre, half = (high + low) / 2, max((high - low) / 2, top * EPS)
        spread = _gain((value[0] - centre) / half) / _gain((value[live - 1] - centre) / half)
        degree = int(np.clip(np.log(p.growth) / np.log(max(spread, 1 + 1e-9)), 2, p.degree))
        before, y = q, (image - centre * q) / half
        for _ in range(degree - 1):
            before, y = y, 2 * (times(y) - centre * y) / half - before
        q = np.linalg.qr(y / np.maximum(np.linalg.norm(y, axis=0), 1e-300))[0]
    q = q[:, :live] * np.where(q[np.abs(q[:, :live]).argmax(axis=0), np.arange(live)] < 0, -1.0, 1.0)
    return Axes(n, v.shift, v.rest, q, value[:live], residual, trace, v.passes)


def identity_error(rows: DataFrame, found: Axes) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured over all rows."""
    dim, k = found.vectors.shape

    def make(parts: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((k + 1, k))
        for x in parts:
            w = found.project(x)
            out[:k] += w.T @ w
            out[k] += w.sum(axis=0)
        return out

    total = _summed(rows, make, dim, (k + 1, k)) / found.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max(initial=0))


def prepare(df: DataFrame, vector: str = "embedding", label: str = "whitening-rows") -> DataFrame:
    """``whole_entries`` written once; every pass reads it. Vectors of an odd length are left out."""
    rows = stage(whole_entries(df, vector), label)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == most.d) if most else rows


def whiten(df: DataFrame, vector: str = "embedding", p: Params = Params()) -> DataFrame:
    """One row per remaining row of ``df`` and component, with the columns of ``df`` but the vector in ``_row``.

    ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation``, ``whitened``, ``explained`` and
    ``identity_error`` are as measured over all remaining rows; ``deviation`` is null where a long does not hold
    it. Which rows remain: ``whole_entries``. Repeated rows count and come out as often as they are given; a null
    key is a key like any other; an empty table, or one of equal vectors, gives no rows.
    """
    rows = prepare(df, vector)
    found = axes(rows, p)
    schema = (rows.select("_row", F.lit(0).alias("component"), *[F.lit(0).cast("long").alias(c) for c in ("n", "deviation")],
                          *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")]).schema)
    if found is None or not len(found.values):
        discard(rows)
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, found)
    dim, k = found.vectors.shape
    explained = found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, dim)
            owner = pa.array(np.repeat(np.arange(len(x)), k))
            own = pa.array(found.deviation(x), pa.int64())
            yield pa.RecordBatch.from_arrays([
                b.column("_row").take(owner), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(owner), found.n)), own.take(owner), pa.array(found.project(x).ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(owner), error))], names=schema.names)

    return rows.mapInArrow(run, schema)
