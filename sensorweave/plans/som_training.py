"""Batch training of self-organizing maps.

The published trainer updates the map after every single row, which only a single thread can do.
This is the standard parallel form: each epoch sums the rows of every neuron across the cluster, and
the map moves towards the kernel-weighted means. Kernels and schedules are the published ones.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.operators.assign import assign, blocks, hit_map, nearest, unused_percent
from sensorweave.functions.scaling import hash_share
from sensorweave.operators.bounds import bounded, neuron_sums, tiles
from sensorweave.operators.codebook import Codebook, array_matrix, neighbourhood, random_codebook, schedule
from sensorweave.sources.stage import discard, stage


@dataclass(frozen=True)
class TrainingParams:
    epochs: int = 8
    kernel: str = "ceil"
    metric: str = "cityblock"
    max_distance: float = 4.0
    schedule: str = "linear"
    sigma: float = 1.0
    lr: float = 1.0
    sigma_decay: float = 0.1
    lr_decay: float = 0.1
    max_iter: int | None = None  # length some schedules decay over; the number of epochs if not given


def _partial_sums(df: DataFrame, features: str, books: Mapping[int, Codebook], share: str | None = None,
                  views: Mapping[int, tuple[float, float]] | None = None) -> DataFrame:
    """Row count, vector sum and squared-distance sum per (config, neuron).

    Every partition sums its own rows, so the shuffle carries at most one row per neuron and task. ``views`` gives
    a configuration the rows whose ``share`` is below its first number, stretched by its second.
    """
    weights = {c: b.weights for c, b in books.items()}
    dim = next(iter(books.values())).dim

    def run(batches):
        n = {c: np.zeros(len(w)) for c, w in weights.items()}
        total = {c: np.zeros((len(w), dim + 1)) for c, w in weights.items()}
        for batch in batches:
            every = array_matrix(batch.column(0), dim)
            for c, w in weights.items():
                x = every
                if views is not None:
                    limit, stretch = views[c]
                    x = every[np.asarray(batch.column(1)) < limit] * stretch
                for part in blocks(x, w) if len(x) else ():
                    idx, dist = nearest(part, w, 1)
                    hit = idx[:, 0]
                    n[c] += np.bincount(hit, minlength=len(w))
                    for j in range(dim):
                        total[c][:, j] += np.bincount(hit, part[:, j], minlength=len(w))
                    total[c][:, dim] += np.bincount(hit, dist[:, 0] ** 2, minlength=len(w))
        for c, w in weights.items():
            hit = np.flatnonzero(n[c])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(hit), c), pa.int32()), pa.array(hit, pa.int32()), pa.array(n[c][hit]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1) * (dim + 1), pa.int32()),
                                         pa.array(total[c][hit].ravel()))],
                names=["config", "bmu", "n", "s"])

    rows = df.select(features, *([share] if views is not None else [])).where(F.col(features).isNotNull())
    return _added(rows.mapInArrow(run, "config int, bmu int, n double, s array<double>"))


def _added(part: DataFrame) -> DataFrame:
    """Partial sums added up by coordinate: one plan whatever the dimension."""
    long = part.select("config", "bmu", "n", F.posexplode("s").alias("i", "v"))
    cells = long.groupBy("config", "bmu", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return cells.groupBy("config", "bmu").agg(F.max("n").alias("n"), F.sort_array(
        F.collect_list(F.struct("i", "v"))).alias("s")).withColumn("s", F.col("s.v"))


def _moved(book: Codebook, n: np.ndarray, sums: np.ndarray, h: np.ndarray, lr: float) -> Codebook:
    """``W + lr (mean - W)`` with the kernel-weighted mean; neurons without kernel mass stay."""
    mass = h.T @ n
    pull = h.T @ sums
    moves = np.abs(mass) > 1e-12
    target = np.where(moves[:, None], pull / np.where(moves, mass, 1.0)[:, None], book.weights)
    return book.with_weights(book.weights + lr * (target - book.weights))


def fit_many(df: DataFrame, starts: Mapping[int, Codebook], params: Mapping[int, TrainingParams] | TrainingParams,
             features: str = "features", share: str | None = None,
             views: Mapping[int, tuple[float, float]] | None = None) -> tuple[dict[int, Codebook], list[dict[int, float]]]:
    """Train several maps of equal dimension on the same rows, one job per epoch for all of them.

    Returns the maps and, per epoch, the mean squared distance each had before its update.
    Cache or stage ``df`` beforehand: every epoch reads it once. ``share`` and ``views`` as in ``_partial_sums``.
    """
    books = dict(starts)
    per = dict(params) if isinstance(params, Mapping) else {c: params for c in books}
    history: list[dict[int, float]] = []
    epochs = max(p.epochs for p in per.values())
    dim = next(iter(books.values())).dim
    for t in range(epochs):
        active = {c: b for c, b in books.items() if t < per[c].epochs}
        rows = _partial_sums(df, features, active, share, views).collect()  # one row per neuron that was hit
        errors = {}
        for c, book in active.items():
            p = per[c]
            n, sums, sq = np.zeros(book.size), np.zeros((book.size, dim)), 0.0
            for r in rows:
                if r["config"] == c:
                    n[r["bmu"]] = r["n"]
                    sums[r["bmu"]] = r["s"][:dim]
                    sq += r["s"][dim]
            if n.sum() == 0:
                raise ValueError("no rows to train on")
            errors[c] = float(sq / n.sum())
            sigma, lr = schedule(p.schedule, p.sigma, p.lr, sigma_decay=p.sigma_decay, lr_decay=p.lr_decay,
                                 max_iter=p.max_iter)(t, p.epochs)
            h = neighbourhood(book, p.kernel, sigma, metric=p.metric, max_distance=p.max_distance)
            books[c] = _moved(book, n, sums, h, lr)
        history.append(errors)
    return books, history


def fit(df: DataFrame, start: Codebook, params: TrainingParams = TrainingParams(),
        features: str = "features") -> tuple[Codebook, list[float]]:
    """Train one map (N14): the map and the mean squared distance before each epoch."""
    books, history = fit_many(df, {0: start}, params, features)
    return books[0], [h[0] for h in history]


def fit_bounded(df: DataFrame, start: Codebook, params: TrainingParams = TrainingParams(), features: str = "features",
                tile: int = 2, rewrite_above: float = 0.2) -> tuple[Codebook, list[dict[str, float]]]:
    """Train one map as ``fit`` does, skipping neurons that cannot be a row's nearest.

    The rows are staged with their neuron and one distance bound per ``tile`` x ``tile`` cells of the grid. Later
    epochs measure only the tiles whose bound, less the way the tile's neurons have gone since, leaves a doubt. The
    table is written anew after an epoch that measured more than ``rewrite_above`` of all distances. Both settings
    change the work alone: map and errors are those of ``fit``. Returns the map and per epoch ``error`` (mean squared
    distance before its update), ``measured`` (distances computed) and ``every`` (rows times neurons).
    """
    groups, book, kept, share = tiles(start, tile), start, None, 1.0
    rows = df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"))
    history: list[dict[str, float]] = []
    for t in range(params.epochs):
        moved = None if kept is None else np.linalg.norm(book.weights - written.weights, axis=1)
        if kept is None or share > rewrite_above:
            fresh = stage(bounded(rows if kept is None else kept, book, groups, moved), "map-bounds")
            if kept is not None:
                discard(kept)
            kept, written, moved = fresh, book, None
        found = _added(neuron_sums(kept, book, groups, moved).selectExpr("0 AS config", "bmu", "n", "s")).collect()
        n, sums, sq = np.zeros(book.size), np.zeros((book.size, book.dim)), 0.0
        measured = 0.0
        for r in found:  # one row per neuron that was hit, and the count of distances
            if r["bmu"] < 0:
                measured = r["n"]
                continue
            n[r["bmu"]], sums[r["bmu"]] = r["n"], r["s"][:book.dim]
            sq += r["s"][book.dim]
        if n.sum() == 0:
            raise ValueError("no rows to train on")
        share = measured / (n.sum() * book.size)
        history.append({"error": float(sq / n.sum()), "measured": measured, "every": float(n.sum() * book.size)})
        sigma, lr = schedule(params.schedule, params.sigma, params.lr, sigma_decay=params.sigma_decay, lr_decay=params.lr_decay,
                             max_iter=params.max_iter)(t, params.epochs)
        h = neighbourhood(book, params.kernel, sigma, metric=params.metric, max_distance=params.max_distance)
        book = _moved(book, n, sums, h, lr)
    if kept is not None:
        discard(kept)
    return book, history


def update_one(book: Codebook, x: Sequence[float], params: TrainingParams, sigma: float, lr: float) -> Codebook:
    """The effect of a single row (N13): every neuron moves by ``lr * h * (x - w)``."""
    row = np.asarray(x, dtype=float)
    hit = int(nearest(row[None, :], book.weights, 1)[0][0, 0])
    h = neighbourhood(book, params.kernel, sigma, metric=params.metric, max_distance=params.max_distance)[hit]
    return book.with_weights(book.weights + lr * h[:, None] * (row - book.weights))


def sweep(df: DataFrame, starts: Mapping[int, Codebook], params: TrainingParams, features: str = "features") -> DataFrame:
    """Unused neurons per grid size (N29, A28): one row per configuration."""
    books, _ = fit_many(df, starts, params, features)
    spark = df.sparkSession
    out = None
    for c, book in books.items():
        pct = unused_percent(hit_map(assign(df, book, features), book.table(spark)))
        row = pct.select(F.lit(c).alias("config"), F.lit(book.rows).alias("som_size"), "unused_pct")
        out = row if out is None else out.unionByName(row)
    return out


@dataclass(frozen=True)
class SweepConfig:
    """One map of a sweep: the share of the rows it sees, the factor they are stretched by, the side of its grid."""

    share: float
    dispersion: float
    side: int


def sweep_table(df: DataFrame, features: str, row_key: Sequence[str], shares: Sequence[float], dispersions: Sequence[float],
                sides: Sequence[int], params: TrainingParams = TrainingParams(epochs=1),
                start: Callable[[SweepConfig, int], Codebook] | None = None, seed: int = 42) -> DataFrame:
    """Unused neurons for every sample size, dispersion and grid (N29, A28, A29): one row per configuration.

    Columns: ``size`` (rows of the sample), ``disp``, ``std`` of all its cells (A13), ``centroid_std`` of the distances to its
    centroid (A15), ``som_size``, ``unused_pct``; sorted by size, dispersion and grid. Samples are nested: a row is in all
    whose share exceeds the hash of its key. One scan per epoch moves every map, one more counts, and two give the
    samples' figures; sums per neuron of all maps reach the driver, whose size the sweep sets. ``start`` gives the
    first map of a configuration and dimension.
    """
    rows = stage(df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), hash_share(row_key, seed).alias("share")), "sweep")
    head = rows.head(1)
    if not head:
        raise ValueError("no rows to sweep over")
    dim = len(head[0]["x"])
    configs = dict(enumerate(SweepConfig(s, d, g) for s in sorted(shares) for d in sorted(dispersions) for g in sorted(sides)))
    start = start or (lambda c, d: random_codebook(c.side, c.side, d, "unit", seed=c.side))
    views = {i: (c.share, c.dispersion) for i, c in configs.items()}
    books, _ = fit_many(rows, {i: start(c, dim) for i, c in configs.items()}, params, "x", "share", views)
    hits = _partial_sums(rows, "x", books, "share", views).groupBy("config").agg(F.count(F.lit(1)).alias("used")).collect()
    used = {r["config"]: r["used"] for r in hits}

    sample = {}
    for s in sorted(shares):  # as aggregates of one scan each
        sample[s] = F.col("share") < s
    cells = F.aggregate("x", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
                        lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")))
    means = rows.withColumn("_c", cells).agg(*[a for i, (s, inside) in enumerate(sample.items()) for a in (
        F.sum(inside.cast("long")).alias(f"n{i}"), F.sum(F.when(inside, F.col("_c.s"))).alias(f"s{i}"),
        F.sum(F.when(inside, F.col("_c.q"))).alias(f"q{i}"), *[F.avg(F.when(inside, F.col("x")[j])).alias(f"m{i}_{j}") for j in range(dim)])]).first()
    centre = {i: [means[f"m{i}_{j}"] for j in range(dim)] for i in range(len(sample)) if means[f"n{i}"]}
    far = {i: F.sqrt(F.aggregate(F.zip_with("x", F.array(*[F.lit(v) for v in m]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v))
           for i, m in centre.items()}
    spread = rows.agg(F.count(F.lit(1)), *[F.stddev_pop(F.when(list(sample.values())[i], d)).alias(f"c{i}") for i, d in far.items()]).first()
    out = []
    for i, c in configs.items():
        k = sorted(shares).index(c.share)
        n = means[f"n{k}"]
        if n:
            mean = means[f"s{k}"] / (n * dim)
            std = max(means[f"q{k}"] / (n * dim) - mean ** 2, 0.0) ** 0.5
            out.append((int(n), float(c.dispersion), std * abs(c.dispersion), spread[f"c{k}"] * abs(c.dispersion), c.side,
                        100.0 * (c.side ** 2 - used.get(i, 0)) / c.side ** 2))
    return df.sparkSession.createDataFrame(out, "size long, disp double, std double, centroid_std double, som_size int, unused_pct double")


def sweep_summary(table: DataFrame) -> DataFrame:
    """Mean and largest share of unused neurons per sample size."""
    return table.groupBy("size").agg(F.avg("unused_pct").alias("mean_unused"), F.max("unused_pct").alias("max_unused"),
                                     F.count(F.lit(1)).alias("n"))
