"""Matching rows with neurons, and the maps that follow from it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorweave.operators.codebook import Codebook, array_matrix, line_shift

_BLOCK = 1 << 20


def distances(x: np.ndarray, w: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distance of every row of ``x`` to every row of ``w``.

    ``chebyshev`` uses absolute differences (the published form leaves them signed). ``sqeuclidean``
    skips the root.
    """
    if metric == "cosine":
        scale = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(w, axis=1)[None, :]
        return 1 - (x @ w.T) / (scale + 1e-8)
    diff = x[:, None, :] - w[None, :, :]
    if metric in ("euclidean", "sqeuclidean"):
        sq = np.einsum("nmd,nmd->nm", diff, diff)
        return np.sqrt(sq) if metric == "euclidean" else sq
    if metric == "manhattan":
        return np.abs(diff).sum(axis=2)
    if metric == "chebyshev":
        return np.abs(diff).max(axis=2)
    raise ValueError(f"unknown distance {metric}")


def nearest(x: np.ndarray, w: np.ndarray, k: int, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of the ``k`` closest rows of ``w``, ties to the lowest index."""
    if metric != "euclidean" or k + 1 >= len(w):
        return _nearest_direct(x, w, k, metric)
    # One matrix product finds the candidates; their distances are then computed from differences,
    # and rows whose order the product cannot decide are done over in full.
    squares = np.einsum("md,md->m", w, w)
    rough = squares - 2.0 * (x @ w.T)
    slack = 1e-12 * w.shape[1] * (np.einsum("nd,nd->n", x, x) + squares.max())
    if k == 1:
        idx = rough.argmin(axis=1)
        limit = np.take_along_axis(rough, idx[:, None], axis=1)[:, 0] + slack
        unsure = np.count_nonzero(rough <= limit[:, None], axis=1) > 1
        idx = idx[:, None]
    else:
        part = np.argpartition(rough, k, axis=1)[:, : k + 1]
        values = np.take_along_axis(rough, part, axis=1)
        order = np.argsort(values, axis=1)
        idx = np.take_along_axis(part, order, axis=1)[:, :k]
        unsure = (np.diff(np.take_along_axis(values, order, axis=1), axis=1) <= slack[:, None]).any(axis=1)
    diff = x[:, None, :] - w[idx]
    dist = np.sqrt(np.einsum("nkd,nkd->nk", diff, diff))
    if unsure.any():
        idx[unsure], dist[unsure] = _nearest_direct(x[unsure], w, k, metric)
    return idx, dist


def _nearest_direct(x: np.ndarray, w: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    root = metric == "euclidean"
    d = distances(x, w, "sqeuclidean" if root else metric)
    idx = d.argmin(axis=1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :k]
    d = np.take_along_axis(d, idx, axis=1)
    return idx, np.sqrt(d) if root else d


def blocks(x: np.ndarray, w: np.ndarray):
    """Slices of ``x`` small enough that all differences with ``w`` stay in cache-sized arrays."""
    step = max(1, _BLOCK // max(w.size, 1))
    for start in range(0, len(x), step):
        yield x[start:start + step]


def assign(df: DataFrame, codebook: Codebook, features: str = "features", k: int = 1,
           metric: str = "euclidean") -> DataFrame:
    """Add the nearest neuron of each row: ``bmu``, ``row``, ``col``, ``dmin``.

    With ``k > 1`` adds arrays ``bmus`` and ``dists`` of length ``k`` (N2, J9), nulls at their end where the
    map has fewer neurons. A narrow step: the codebook travels
    with the task, the rows stay where they are. Rows with null features get nulls.
    """
    w, cols = codebook.weights, codebook.cols
    dim = codebook.dim
    there = min(k, codebook.size)
    out_type = "bmus array<int>, dists array<double>" if k > 1 else "bmu int, dmin double"

    def match(column: pa.Array) -> pa.Array:
        # Null feature arrays are left out of the matrix and put back as nulls.
        known = np.asarray(column.is_valid())
        idx = np.zeros((len(column), k), dtype=np.int32)
        dist = np.zeros((len(column), k))
        if known.any():
            x = array_matrix(column, dim)
            found = [nearest(part, w, there, metric) for part in blocks(x, w)]
            idx[known, :there] = np.concatenate([f[0] for f in found])
            dist[known, :there] = np.concatenate([f[1] for f in found])
        absent = ~known
        if k == 1:
            return pa.StructArray.from_arrays(
                [pa.array(idx[:, 0], pa.int32(), mask=absent), pa.array(dist[:, 0], pa.float64(), mask=absent)],
                names=["bmu", "dmin"])
        ends = pa.array(np.arange(len(column) + 1) * k, pa.int32())
        mask = pa.array(absent)
        beyond = np.tile(np.arange(k) >= there, len(column))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(ends, pa.array(idx.ravel(), pa.int32(), mask=beyond), mask=mask),
             pa.ListArray.from_arrays(ends, pa.array(dist.ravel(), pa.float64(), mask=beyond), mask=mask)],
            names=["bmus", "dists"])

    match = F.arrow_udf(match, out_type)
    df = df.withColumn("_match", match(F.col(features)))
    if k > 1:
        return df.withColumns({"bmus": F.col("_match.bmus"), "dists": F.col("_match.dists")}).drop("_match")
    df = df.withColumns({"bmu": F.col("_match.bmu"), "dmin": F.col("_match.dmin")}).drop("_match")
    return df.withColumns({"row": F.expr(f"cast(bmu div {cols} as int)"), "col": F.col("bmu") % cols})


def assign_columns(df: DataFrame, codebook: Codebook, cols: Sequence[str]) -> DataFrame:
    """``assign`` for plain double columns and small maps, as generated JVM code without Python.

    Every distance is an unrolled expression, so ``map size x dimensions`` should stay under a few
    thousand terms; use ``assign`` beyond that.
    """
    w, grid_cols = codebook.weights, codebook.cols

    def squared(j: int) -> Column:
        total = F.lit(0.0)
        for c, v in zip(cols, w[j]):
            gap = F.col(c) - F.lit(float(v))
            total = total + gap * gap
        return total

    df = df.withColumn("_d", F.array(*[squared(j) for j in range(codebook.size)]))
    df = df.withColumn("_min", F.array_min("_d"))
    df = df.withColumns({"bmu": (F.array_position("_d", F.col("_min")) - 1).cast("int"), "dmin": F.sqrt("_min")})
    return df.withColumns({"row": F.expr(f"cast(bmu div {grid_cols} as int)"), "col": F.col("bmu") % grid_cols}).drop("_d", "_min")


def distance_table(df: DataFrame, codebook: Codebook, features: str = "features", metric: str = "euclidean") -> DataFrame:
    """Every row against every neuron (J8, N27): ``bmu``, ``dist``; map size times the input, for inspection."""
    w, dim = codebook.weights, codebook.dim

    def measure(column: pa.Array) -> pa.Array:
        known = np.asarray(column.is_valid())
        dist = np.zeros((len(column), len(w)))
        if known.any():
            dist[known] = np.concatenate([distances(part, w, metric) for part in blocks(array_matrix(column, dim), w)])
        ends = pa.array(np.arange(len(column) + 1) * len(w), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(dist.ravel()), mask=pa.array(~known))

    measure = F.arrow_udf(measure, "array<double>")
    # Materialised before the explode so the distances of a row are computed once.
    return df.withColumn("_all", measure(F.col(features))).select(*df.columns, F.posexplode("_all").alias("bmu", "dist"))


def quantize(df: DataFrame, codebook: Codebook, codebook_table: DataFrame, features: str = "features") -> DataFrame:
    """The weight vector of each row's neuron, as column ``w``."""
    return assign(df, codebook, features).join(F.broadcast(codebook_table.select("bmu", "w")), "bmu", "left")


# --- quality -----------------------------------------------------------------------------------------

def quantization_error(assigned: DataFrame) -> DataFrame:
    """Mean distance to the nearest neuron (N4) and inertia, the sum of its squares."""
    return assigned.agg(F.avg("dmin").alias("quantization_error"),
                        F.sum(F.col("dmin") * F.col("dmin")).alias("inertia"))


def topographic_error(two_best: DataFrame, cols: int, n_neurons: int, topology: str = "rectangular") -> DataFrame:
    """Share of rows whose two nearest neurons are not neighbours on the grid.

    Takes ``assign(..., k=2)``. ``hexagonal`` shifts every second grid line by half a cell and calls
    neurons neighbours when both plane coordinates differ by at most one. Null for a one-cell map.
    """
    if n_neurons < 2:
        return two_best.agg(F.lit(None).cast("double").alias("topographic_error"))

    def at(i: int) -> tuple[Column, Column]:
        bmu = F.col("bmus")[i]
        return F.expr(f"bmus[{i}] div {cols}").cast("double"), (bmu % cols).cast("double")

    (r1, c1), (r2, c2) = at(0), at(1)
    if topology == "hexagonal":
        shift = F.array(*[F.lit(float(line_shift(i, cols))) for i in range(cols)])
        r1, r2 = [r - F.get(shift, c.cast("int")) for r, c in ((r1, c1), (r2, c2))]
    apart = F.greatest(F.abs(r1 - r2), F.abs(c1 - c2)) > 1
    return two_best.agg(F.avg(apart.cast("double")).alias("topographic_error"))


def hit_map(assigned: DataFrame, codebook_table: DataFrame) -> DataFrame:
    """Hits per neuron, unhit neurons with 0."""
    hits = assigned.where("bmu IS NOT NULL").groupBy("bmu").agg(F.count(F.lit(1)).alias("hits"))
    return codebook_table.join(hits, "bmu", "left").select(
        "bmu", "row", "col", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def distance_maps(assigned: DataFrame, codebook_table: DataFrame) -> DataFrame:
    """Smallest and largest distance of each neuron's rows, null if unhit (A19, N18 ``by_bmu``)."""
    spread = assigned.groupBy("bmu").agg(F.min("dmin").alias("dmin"), F.max("dmin").alias("dmax"))
    return codebook_table.select("bmu", "row", "col").join(spread, "bmu", "left")


def unused_percent(hits: DataFrame) -> DataFrame:
    """Share of neurons without a hit, in percent."""
    return hits.agg((F.avg((F.col("hits") == 0).cast("double")) * 100).alias("unused_pct"))


def label_counts(assigned: DataFrame, label: str) -> DataFrame:
    """Rows per neuron and label."""
    return assigned.groupBy("bmu", label).agg(F.count(F.lit(1)).alias("n"))


def binary_label_map(assigned: DataFrame, codebook_table: DataFrame, label: str) -> DataFrame:
    """1 where more than half of a neuron's rows have label 1, else 0; 2 where it has no rows."""
    share = assigned.groupBy("bmu").agg(F.avg(label).alias("_share"))
    value = F.when(F.col("_share").isNull(), 2).when(F.col("_share") > 0.5, 1).otherwise(0)
    return codebook_table.join(share, "bmu", "left").select("bmu", "row", "col", value.alias("neuron_label"))


def majority_label_map(assigned: DataFrame, codebook_table: DataFrame, label: str, order: str) -> DataFrame:
    """Most frequent label of a neuron, ties to the label seen first in ``order``; 2 if unhit."""
    counts = assigned.groupBy("bmu", label).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    best = counts.groupBy("bmu").agg(F.min(F.struct(-F.col("_n"), F.col("_first"), F.col(label).alias("_l")))["_l"].alias("_l"))
    return codebook_table.join(best, "bmu", "left").select(
        "bmu", "row", "col", F.coalesce(F.col("_l"), F.lit(2)).alias("neuron_label"))


def predict_label(assigned: DataFrame, label_map: DataFrame) -> DataFrame:
    """Each row with its neuron's label (N23). The map has one row per neuron."""
    return assigned.join(F.broadcast(label_map.select("bmu", "neuron_label")), "bmu", "left")


def members(assigned: DataFrame, row_key: str) -> DataFrame:
    """Rows of each neuron, as one table row per member.

    Long form on purpose: a neuron may hold most of the data, so its members never become one array.
    """
    return assigned.where("bmu IS NOT NULL").select("bmu", "row", "col", row_key)


def u_matrix(codebook: Codebook, spark, scaling: str = "mean", topology: str = "rectangular") -> DataFrame:
    """Mean or sum of the distances to the grid neighbours, divided by the largest such value.

    Neighbours on the square grid are the cells around a cell. On the hexagonal grid columns lie half the
    square root of three apart and every second one half a cell lower: neighbours are one cell away.
    """
    near = codebook.table(spark)
    b = near.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("w").alias("_w"))
    for c in ("_dr", "_dc"):
        near = near.withColumn(c, F.explode(F.sequence(F.lit(-1), F.lit(1))))
    if topology == "rectangular":
        away = F.greatest(F.abs("_dr"), F.abs("_dc")).cast("double")
    else:
        lower = (F.pmod(F.col("col") + F.col("_dc"), F.lit(2)) - F.pmod(F.col("col"), F.lit(2))) / 2
        away = F.hypot(F.col("_dc") * F.sqrt(F.lit(0.75)), F.col("_dr") + lower)
    near = near.where((away > 0.5) & (away < 1.5)).select(
        "bmu", "row", "col", "w", (F.col("row") + F.col("_dr")).alias("_r"), (F.col("col") + F.col("_dc")).alias("_c"))
    sq = F.zip_with("w", "_w", lambda x, y: (x - y) * (x - y))
    dist = F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, v: s + v))
    how = F.avg(dist) if scaling == "mean" else F.sum(dist)
    out = near.join(F.broadcast(b), ["_r", "_c"]).groupBy("bmu", "row", "col").agg(how.alias("_u"))
    top = out.agg(F.max("_u").alias("_max"))
    return out.crossJoin(F.broadcast(top)).select("bmu", "row", "col", (F.col("_u") / F.col("_max")).alias("u"))


def grid_side(df: DataFrame) -> DataFrame:
    """Side of a square map for the number of rows (N28): 5 sqrt(N) neurons, rounded up to a square."""
    n = F.count(F.lit(1))
    neurons = F.floor(F.sqrt(n.cast("double")) * 5)
    return df.agg(n.alias("n_rows"), neurons.alias("neurons"), F.ceil(F.sqrt(neurons.cast("double"))).alias("side"))
