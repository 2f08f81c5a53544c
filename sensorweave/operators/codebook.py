"""The map of a self-organizing map: a small grid of weight vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from hashlib import md5

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.functions.scaling import hash_share

SCHEMA = T.StructType([
    T.StructField("bmu", T.IntegerType(), False), T.StructField("row", T.IntegerType(), False),
    T.StructField("col", T.IntegerType(), False), T.StructField("w", T.ArrayType(T.DoubleType()), False)])


@dataclass(frozen=True)
class Codebook:
    """``weights`` is ``(rows * cols, dim)``; neuron ``bmu`` sits at ``(bmu // cols, bmu % cols)``.

    On a ``hexagonal`` map every second grid line, counted from the last one backwards, lies half a cell lower
    (``plane``); kernels, grid distances and the topographic error all measure there.

    Its size is set by the caller's grid, not by the data, so it may live on the driver and be
    shipped to every task.
    """

    weights: np.ndarray
    rows: int
    cols: int
    topology: str = "rectangular"

    def __post_init__(self):
        if self.topology not in ("rectangular", "hexagonal"):
            raise ValueError(f"unknown topology {self.topology}")

    @classmethod
    def from_rows(cls, vectors: Sequence[Sequence[float]], rows: int, cols: int, topology: str = "rectangular") -> "Codebook":
        weights = np.asarray(vectors, dtype=float)
        if weights.shape[0] != rows * cols:
            raise ValueError(f"{rows} x {cols} map needs {rows * cols} vectors, got {weights.shape[0]}")
        return cls(weights, rows, cols, topology)

    @property
    def dim(self) -> int:
        return self.weights.shape[1]

    @property
    def size(self) -> int:
        return self.weights.shape[0]

    def positions(self) -> np.ndarray:
        flat = np.arange(self.size)
        return np.column_stack([flat // self.cols, flat % self.cols])

    def plane(self) -> np.ndarray:
        """Where the neurons lie: the grid positions, shifted lines on a hexagonal map."""
        p = self.positions().astype(float)
        if self.topology == "hexagonal":
            p[:, 0] -= line_shift(p[:, 1], self.cols)
        return p

    def with_weights(self, weights: np.ndarray) -> "Codebook":
        return replace(self, weights=weights)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, i // self.cols, i % self.cols, [float(v) for v in w]) for i, w in enumerate(self.weights)]
        return spark.createDataFrame(rows, SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame) -> "Codebook":
        rows = table.orderBy("bmu").collect()
        return cls.from_rows([r["w"] for r in rows], max(r["row"] for r in rows) + 1, max(r["col"] for r in rows) + 1)


def line_shift(line, lines: int):
    """Fixed layout of hexagonal maps: from the last grid line backwards, every second one moves by half a cell."""
    return 0.5 * ((lines - 1 - line) % 2 == 0)


def draws(seed: int, rows: int, cols: int, part: int = 0) -> np.ndarray:
    """Numbers in [0, 1) by place: the leading 32 bits of the MD5 of seed, part, row and column, comma-joined."""
    digests = (md5(f"{seed},{part},{r},{c}".encode()).digest() for r in range(rows) for c in range(cols))
    return np.array([int.from_bytes(d[:4], "big") for d in digests], dtype=float).reshape(rows, cols) / 2.0 ** 32


def random_codebook(rows: int, cols: int, dim: int, kind: str = "uniform", seed: int = 0) -> Codebook:
    """Data-free start (N6): ``uniform`` [0, 1), ``normal``, ``sq_normal`` (square minus one), or
    ``unit`` (uniform [-1, 1) scaled to length one). The same numbers on any engine: see ``draws``."""
    shape = (rows * cols, dim)
    u = draws(seed, *shape)
    if kind == "uniform":
        weights = u
    elif kind in ("normal", "sq_normal"):
        weights = np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * draws(seed, *shape, 1))
        if kind == "sq_normal":
            weights = weights ** 2 - 1
    elif kind == "unit":
        weights = 2 * u - 1
        weights = weights / np.linalg.norm(weights, axis=1, keepdims=True)
    else:
        raise ValueError(f"unknown kind {kind}")
    return Codebook(weights, rows, cols)


def sampled_codebook(df: DataFrame, features: str, row_key: Sequence[str], rows: int, cols: int, seed: int = 0) -> Codebook:
    """Start from data rows picked by key hash, repeatable whatever the partitioning (N7). Runs a job."""
    m = rows * cols
    # The map size bounds the result; each task keeps its m best rows only.
    picked = df.orderBy(hash_share(row_key, seed), *row_key).limit(m).select(features).collect()
    if not picked:
        raise ValueError("no rows to start from")
    return Codebook.from_rows([picked[i % len(picked)][0] for i in range(m)], rows, cols)


def covariance(df: DataFrame, features: str, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, sample covariance and row count, from partial sums per partition (runs two jobs)."""
    import pyarrow as pa

    def partial(centre, square):
        def run(batches):
            n, total = 0, np.zeros(dim * dim if square else dim)
            for batch in batches:
                x = array_matrix(batch.column(0), dim) - centre
                n += len(x)
                total += (x.T @ x).ravel() if square else x.sum(axis=0)
            size = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size + 1), pa.int32()), pa.array(np.append(total, n), pa.float64())], names=["i", "v"])

        summed = df.select(features).where(F.col(features).isNotNull()).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        return np.array([r.v for r in summed.orderBy("i").collect()])

    zero = np.zeros(dim)
    sums = partial(zero, False)
    n = int(sums[-1])
    mean = sums[:-1] / n
    squares = partial(mean, True)
    return mean, squares[:-1].reshape(dim, dim) / (n - 1), n


def principal_axes(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``k`` eigenvectors (columns) and the variance share of each.

    Sign rule: the largest absolute entry of an axis is positive.
    """
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    axes = vectors[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return axes, values[order] / values.sum()


def pca_codebook(df: DataFrame, features: str, dim: int, rows: int, cols: int) -> Codebook:
    """Start spanning the first two principal axes of (normalised) data."""
    if dim < 2:
        raise ValueError("principal-axis start needs at least two features")
    _, cov, _ = covariance(df, features, dim)
    axes, _ = principal_axes(cov, 2)
    a, b = np.linspace(-1, 1, rows), np.linspace(-1, 1, cols)
    weights = a[:, None, None] * axes[:, 0] + b[None, :, None] * axes[:, 1]
    return Codebook(weights.reshape(rows * cols, dim), rows, cols)


def array_matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column without nulls as an ``(n, dim)`` matrix."""
    return np.asarray(column.flatten(), dtype=float).reshape(-1, dim)


# --- grid distances and neighbourhoods -------------------------------------------------------------

def grid_distance(codebook: Codebook, metric: str = "cityblock") -> np.ndarray:
    """Distance between every two neurons on the grid (N9): ``cityblock`` or ``euclidean``."""
    p = codebook.plane()
    diff = np.abs(p[:, None, :] - p[None, :, :])
    if metric == "cityblock":
        return diff.sum(axis=2)
    if metric == "euclidean":
        return np.sqrt((diff ** 2).sum(axis=2))
    raise ValueError(f"unknown grid metric {metric}")


def neighbourhood(codebook: Codebook, kind: str, sigma: float, *, metric: str = "cityblock",
                  max_distance: float = 4.0) -> np.ndarray:
    """Influence ``h[b, j]`` of a hit on neuron ``b`` on neuron ``j``.

    ``ceil`` disc of radius ceil(sigma * max_distance); ``half`` 2^-d; ``exp`` exp(-d^2 / 2 sigma^2);
    ``mult`` sigma * d (grows with distance, as published); ``gaussian`` and ``mexican_hat`` on the
    Euclidean plane; ``bubble`` and ``triangle`` per axis of the grid, whatever the topology; ``fixed_gaussian`` exp(-d^2 / sigma^2);
    ``square`` Gaussian of squared radius ``sigma`` inside ``[-step, step)`` with step =
    ``max_distance``, the hit neuron alone once the squared radius is under 1e-3; ``density``
    sigma times the standard normal density of d^2.
    """
    p, cell = codebook.plane(), codebook.positions().astype(float)
    step, cells = (v[None, :, :] - v[:, None, :] for v in (p, cell))
    sq = (step ** 2).sum(axis=2)
    if kind in ("ceil", "half", "exp", "mult"):
        d = grid_distance(codebook, metric)
        if kind == "ceil":
            return (d <= np.ceil(sigma * max_distance)).astype(float)
        if kind == "half":
            return 0.5 ** d
        if kind == "exp":
            return np.exp(-(d ** 2) / (2 * sigma ** 2)) if sigma > 0 else (d == 0).astype(float)
        return sigma * d
    if kind == "gaussian":
        return np.exp(-sq / (2 * sigma * sigma))
    if kind == "mexican_hat":
        scaled = sq / (2 * sigma * sigma)
        return np.exp(-scaled) * (1 - 2 * scaled)
    if kind == "bubble":
        return (np.abs(cells) < sigma).all(axis=2).astype(float)
    if kind == "triangle":
        return np.clip(sigma - np.abs(cells), 0, None).prod(axis=2)
    if kind == "fixed_gaussian":
        return np.exp(-sq / sigma ** 2)
    if kind == "square":
        if sigma < 1e-3:
            return (sq == 0).astype(float)
        near = ((step >= -max_distance) & (step < max_distance)).all(axis=2)
        return np.exp(-sq / 2 / sigma) * near
    if kind == "density":
        return sigma * np.exp(-(sq ** 2) / 2) / np.sqrt(2 * np.pi)
    raise ValueError(f"unknown neighbourhood {kind}")


Schedule = Callable[[int, int], tuple[float, float]]


def schedule(kind: str, sigma: float = 1.0, lr: float = 1.0, *, sigma_decay: float = 0.1, lr_decay: float = 0.1,
             max_iter: int | None = None) -> Schedule:
    """``(epoch, epochs) -> (sigma, lr)`` by name.

    ``exp``, ``linear``, ``mix`` (sigma exponential, lr linear), ``inv`` (counted from 1, since the
    published form divides by the 0-based step), ``constant``, ``step_ratio`` (both shrink by a fixed
    ratio per step), ``asymptotic``.
    """

    def at(t: int, total: int) -> tuple[float, float]:
        limit = max_iter or total
        if kind == "exp":
            return sigma * np.exp(-t * sigma_decay), lr * np.exp(-t * lr_decay)
        if kind == "linear":
            left = 1.0 - t / total
            return sigma * left, lr * left
        if kind == "mix":
            return sigma * np.exp(-t / limit), lr * (1.0 - t / total)
        if kind == "inv":
            return sigma / (t + 1), lr / (t + 1)
        if kind == "constant":
            return sigma, lr
        if kind == "step_ratio":
            return sigma / (1 + sigma_decay / (limit / 2)) ** t, lr / (1 + lr_decay / (limit / 2)) ** t
        if kind == "asymptotic":
            return sigma / (1 + t / (total / 2)), lr / (1 + t / (total / 2))
        raise ValueError(f"unknown schedule {kind}")

    return at
