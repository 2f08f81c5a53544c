"""Stateless scoring of streams with frozen models (X3, X5) and the online map update."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sensorweave.operators.assign import assign
from sensorweave.operators.codebook import Codebook, neighbourhood
from sensorweave.operators.fuzzy import FuzzyModel, predict
from sensorweave.operators.novelty import allowed_nodes, knn_score, qe_novelty
from sensorweave.plans.som_training import _moved, _partial_sums
from sensorweave.streaming.versions import MapVersions


def stream_qe_novelty(sdf: DataFrame, codebook: Codebook, stats: DataFrame, features: str = "features",
                      fiability: float = 1.0) -> DataFrame:
    """Quantization-error score of each arriving row (X3); ``stats`` is a static table, one row per neuron."""
    return qe_novelty(sdf, stats, codebook, features, fiability)


def stream_knn_novelty(sdf: DataFrame, codebook: Codebook, train: DataFrame, features: str = "features",
                       k: int = 3, min_hits: int = 1) -> DataFrame:
    """Nearest-node score of each arriving row, nodes counted on training rows."""
    nodes = allowed_nodes(codebook, assign(train, codebook, features), min_hits)
    return knn_score(sdf, nodes, features, k)


def stream_predict(sdf: DataFrame, model: FuzzyModel, out: str = "prediction") -> DataFrame:
    """Neuro-fuzzy score of each arriving row."""
    return predict(sdf, model, out)


def online_update(book: Codebook, rows: DataFrame, features: str, *, sigma: float, lr: float, kernel: str = "exp",
                  metric: str = "cityblock", max_distance: float = 4.0) -> Codebook:
    """Move a fitted map towards new rows by one batch step at the final sigma and learning rate."""
    hits = _partial_sums(rows, features, {0: book}).collect()  # one row per neuron that was hit
    if not hits:
        return book
    n, sums = np.zeros(book.size), np.zeros((book.size, book.dim))
    for r in hits:
        n[r["bmu"]] = r["n"]
        sums[r["bmu"]] = r["s"][:book.dim]
    return _moved(book, n, sums, neighbourhood(book, kernel, sigma, metric=metric, max_distance=max_distance), lr)


def stream_update_som(sdf: DataFrame, path: str, start: Codebook, checkpoint: str, features: str = "features", *,
                      sigma: float, lr: float, kernel: str = "exp", keep: int = 8, trigger: dict | None = None):
    """Keep a map up to date with a stream (X4): one step per micro-batch, the last ``keep`` versions stay.

    Version ``n`` of the log below ``path`` (``MapVersions``) is the map after batch ``n``; version -1 is the start.
    A batch that is replayed after a failure finds its version committed, or the one before it as it was, so
    it counts once. A start again from the same checkpoint goes on from the last version. Returns the started query.
    """
    log = MapVersions(sdf.sparkSession, path)
    if log.last() is None:
        log.commit(-1, start)

    def step(batch: DataFrame, batch_id: int) -> None:
        log = MapVersions(batch.sparkSession, path)
        if log.last() >= batch_id:
            return
        log.commit(batch_id, online_update(log.read(), batch, features, sigma=sigma, lr=lr, kernel=kernel))
        log.compact(keep)

    writer = sdf.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_to_table(sdf: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a streaming table over all data there is now, write it as Parquet, and read it back."""
    query = (sdf.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(path)
