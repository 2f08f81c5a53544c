"""Nearest neurons by bounds that rows keep while a map moves.

A row remembers its neuron and, for every group of neurons close on the grid, a distance that none of the
group's other neurons was below. When the map has moved, such a bound shrinks by the longest way a neuron of
the group went. A group whose bound still exceeds the distance to the row's own neuron cannot win and is
skipped, so only groups in doubt are measured. The neurons found are those of ``nearest``, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.operators.assign import _BLOCK, distances
from sensorweave.operators.codebook import Codebook, array_matrix

_SLACK = 1e-9  # far above the rounding of a distance, so a tie is always measured

STATE = "x array<double>, bmu int, d double, low array<float>, measured int"


def tiles(codebook: Codebook, side: int = 2) -> list[np.ndarray]:
    """Neurons by square tiles of the grid, ``side`` cells wide."""
    cell = codebook.positions() // side
    code = cell[:, 0] * codebook.cols + cell[:, 1]
    return [np.flatnonzero(code == c) for c in np.unique(code)]


def search(x: np.ndarray, w: np.ndarray, groups: list[np.ndarray], guess: np.ndarray | None = None,
           low: np.ndarray | None = None, moved: np.ndarray | None = None):
    """Nearest rows of ``w``, their distances, new bounds by group, and the distances measured per row.

    ``guess`` and ``low`` are what an earlier search returned, ``moved`` how far each neuron has gone since.
    Without them everything is measured.
    """
    n = len(x)
    if guess is None:
        guess, reach = np.zeros(n, dtype=np.intp), np.full((n, len(groups)), -np.inf)
    else:
        reach = low * (1 - _SLACK) - np.array([moved[g].max() for g in groups]) * (1 + _SLACK)
    own = distances_to(x, w[guess])
    best, hit = own.copy(), guess.copy()
    measured = np.ones(n, dtype=np.int32)
    doubt = reach <= (np.sqrt(own) * (1 + _SLACK))[:, None]
    first = reach.copy()  # least distance of a group's neurons but for the guess, or a bound below it
    second = np.full_like(reach, np.inf)
    winner = np.full(n, -1)  # the group that the guess lost to
    for i, g in enumerate(groups):
        at = np.flatnonzero(doubt[:, i])
        if not len(at):
            continue
        sq = distances(x[at], w[g], "sqeuclidean")
        measured[at] += len(g)
        sq[g[None, :] == guess[at][:, None]] = np.inf
        j = sq.argmin(axis=1)
        least = np.take_along_axis(sq, j[:, None], axis=1)[:, 0]
        first[at, i] = np.sqrt(least)
        if len(g) > 1:
            second[at, i] = np.sqrt(np.partition(sq, 1, axis=1)[:, 1])
        better = (least < best[at]) | ((least == best[at]) & (g[j] < hit[at]))
        won = at[better]
        best[won], hit[won], winner[won] = least[better], g[j[better]], i
    new = first
    lost = np.flatnonzero(winner >= 0)
    new[lost, winner[lost]] = second[lost, winner[lost]]
    home = np.empty(len(w), dtype=np.intp)
    for i, g in enumerate(groups):
        home[g] = i
    was = home[guess[lost]]
    new[lost, was] = np.minimum(new[lost, was], np.sqrt(own[lost]))
    return hit, np.sqrt(best), rounded_down(new), measured


def distances_to(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x`` to the same row of ``w``, summed as ``distances`` sums it."""
    diff = x[:, None, :] - w[:, None, :]
    return np.einsum("nmd,nmd->nm", diff, diff)[:, 0]


def rounded_down(v: np.ndarray) -> np.ndarray:
    small = v.astype(np.float32)
    return np.where(small > v, np.nextafter(small, np.float32(-np.inf)), small)


def _searched(batch: pa.RecordBatch, w: np.ndarray, groups: list[np.ndarray], moved: np.ndarray | None, dim: int):
    """Blocks of ``x`` with what ``search`` finds for them."""
    x = array_matrix(batch.column("x"), dim)
    known = moved is not None
    if known:
        guess, low = batch.column("bmu").to_numpy().astype(np.intp), np.asarray(batch.column("low").flatten()).reshape(len(x), -1)
    step = max(1, _BLOCK // (dim * max(len(g) for g in groups) + len(groups)))
    for at in range(0, len(x), step):
        cut = slice(at, at + step)
        yield x[cut], *search(x[cut], w, groups, *((guess[cut], low[cut], moved) if known else ()))


def bounded(rows: DataFrame, codebook: Codebook, groups: list[np.ndarray], moved: np.ndarray | None = None) -> DataFrame:
    """Rows with neuron ``bmu``, distance ``d``, bounds ``low`` and how many distances were ``measured``.

    ``rows`` has ``x``, arrays without nulls, and with ``moved`` also ``bmu`` and ``low`` of an earlier call.
    """
    w, dim = codebook.weights, codebook.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, hit, d, low, measured in _searched(batch, w, groups, moved, dim):
                def lists(v, width):
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(v.ravel()))

                yield pa.RecordBatch.from_arrays([lists(x, dim), pa.array(hit.astype(np.int32)), pa.array(d), lists(low, len(groups)),
                                                  pa.array(measured)], names=["x", "bmu", "d", "low", "measured"])

    cols = ["x"] if moved is None else ["x", "bmu", "low"]
    return rows.select(*cols).mapInArrow(run, STATE)


def neuron_sums(rows: DataFrame, codebook: Codebook, groups: list[np.ndarray], moved: np.ndarray | None = None) -> DataFrame:
    """Per task and neuron: ``n`` rows, and ``s``, the sums of their vectors and of the squared distance.

    Without ``moved`` the rows' own ``bmu`` and ``d`` count; with it their neurons are searched for by the
    bounds, and nothing is written. A row with ``bmu`` -1 has the distances measured as ``n``.
    """
    w, dim = codebook.weights, codebook.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, seen = np.zeros(len(w)), np.zeros((len(w), dim + 1)), 0.0
        for batch in batches:
            if moved is None:
                found = [(array_matrix(batch.column("x"), dim), batch.column("bmu").to_numpy(), batch.column("d").to_numpy(),
                          None, batch.column("measured").to_numpy())]
            else:
                found = _searched(batch, w, groups, moved, dim)
            for x, hit, d, _, measured in found:
                n += np.bincount(hit, minlength=len(w))
                for j in range(dim):
                    total[:, j] += np.bincount(hit, x[:, j], minlength=len(w))
                total[:, dim] += np.bincount(hit, d ** 2, minlength=len(w))
                seen += measured.sum(dtype=np.int64)
        hit = np.flatnonzero(n)
        sums = np.concatenate([total[hit], np.zeros((1, dim + 1))])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(hit, -1), pa.int32()), pa.array(np.append(n[hit], seen)),
            pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 2) * (dim + 1), pa.int32()), pa.array(sums.ravel()))],
            names=["bmu", "n", "s"])

    cols = ["x", "bmu", "d", "measured"] if moved is None else ["x", "bmu", "low"]
    return rows.select(*cols).mapInArrow(run, "bmu int, n double, s array<double>")


def distance_summary(df: DataFrame, codebook: Codebook, features: str = "features", metric: str = "euclidean") -> DataFrame:
    """Distances of all rows to each neuron (J8, N27), as ``n``, ``dmin``, ``dmean``, ``dmax`` per neuron.

    Tasks hand over one row per neuron, so the result grows with the map alone. Rows with null features do not count;
    without rows there is no result row.
    """
    w, dim = codebook.weights, codebook.dim
    step = max(1, _BLOCK // max(w.size, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(w))
        least, most = np.full(len(w), np.inf), np.full(len(w), -np.inf)
        for batch in batches:
            x = array_matrix(batch.column(0), dim)
            for at in range(0, len(x), step):
                d = distances(x[at:at + step], w, metric)
                n, total = n + len(d), total + d.sum(axis=0)
                least, most = np.minimum(least, d.min(axis=0)), np.maximum(most, d.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w)), pa.int32()), pa.array(np.full(len(w), n)),
                                              pa.array(total), pa.array(least), pa.array(most)], names=["bmu", "n", "s", "least", "most"])

    part = df.select(features).where(F.col(features).isNotNull()).mapInArrow(run, "bmu int, n long, s double, least double, most double")
    return part.groupBy("bmu").agg(F.sum("n").alias("n"), F.min("least").alias("dmin"), (F.sum("s") / F.sum("n")).alias("dmean"),
                                   F.max("most").alias("dmax"))
