"""Novelty of working-hours rows, from cleaned series to scores."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.functions.scaling import Scaler, hash_split
from sensorweave.operators.calendar import drop_days, numbered_working_days
from sensorweave.operators.codebook import random_codebook
from sensorweave.operators.novelty import knn_novelty, qe_score, training_stats
from sensorweave.operators.assign import assign
from sensorweave.plans.som_training import TrainingParams, fit
from sensorweave.sources.stage import stage as stage_table
from sensorweave.spec import SeriesSpec


@dataclass(frozen=True)
class NoveltyRun:
    """The defaults are the published study's map."""

    rows: int = 12
    cols: int = 12
    training: TrainingParams = field(default_factory=lambda: TrainingParams(epochs=8, max_distance=6, lr=0.5))
    start: str = "05:00"
    end: str = "17:30"
    removed_days: Sequence[dt.date] = ()
    train_percent: int = 80
    neighbours: int = 3
    seed: int = 0


def working_hours_novelty(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], row_key: Sequence[str],
                          params: NoveltyRun = NoveltyRun(),
                          stage: Callable[[DataFrame], DataFrame] = stage_table) -> DataFrame:
    """Split, scale by the training rows, fit a map, score the test rows three ways.

    Output: keys, ``row_key``, time, ``nd_worst``, ``nd_by_bmu`` (1 known, 0 novel) and ``knn`` (higher
    is more novel). The scaled vectors are staged, since every epoch reads them.
    """
    keep = list(dict.fromkeys([*spec.keys, *row_key, spec.ts, *cols]))
    days = drop_days(df, spec, params.removed_days).select(*keep)
    days = numbered_working_days(days, spec, params.start, params.end, stage).drop("day_id")
    rows = stage(hash_split(days.dropna(subset=list(cols)), [*spec.keys, *row_key], params.train_percent))
    scaler = Scaler.fit(rows.where("is_train"), cols)
    vectors = stage(scaler.transform(rows).select(
        *spec.keys, *[c for c in dict.fromkeys([*row_key, spec.ts]) if c not in spec.keys], "is_train",
        F.array(*[F.col(c) for c in cols]).alias("features")))
    train, test = vectors.where("is_train").drop("is_train"), vectors.where("NOT is_train").drop("is_train")
    book, _ = fit(train, random_codebook(params.rows, params.cols, len(cols), seed=params.seed), params.training)
    stats = training_stats(train, book, "both")
    knn = knn_novelty(test, book, k=params.neighbours)
    scored = assign(knn, book).join(F.broadcast(stage(stats)), "bmu", "left")  # one row per neuron
    return scored.withColumns({
        "nd_worst": qe_score(F.col("dmin"), F.col("mean_dist"), F.col("worst")),
        "nd_by_bmu": qe_score(F.col("dmin"), F.col("mean_dist"), F.col("dmax")),
    }).drop("features", "bmu", "row", "col", "dmin", "mean_dist", "worst", "dmax")
