"""The supervised data set: smoothed signals, clock features, a lead target, whole working days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.operators.calendar import drop_days, numbered_working_days
from sensorweave.operators.features import centred_mean, clock_features
from sensorweave.operators.ordered import drop_halo, halo_window, with_halo
from sensorweave.sources.stage import stage as stage_table
from sensorweave.spec import SeriesSpec


@dataclass(frozen=True)
class SupervisedParams:
    target: str
    smoothed: Sequence[str]
    difference: tuple[str, str] | None = None
    kernel: int = 5
    ahead: int = 30
    start: str = "05:00"
    end: str = "17:30"
    removed_days: Sequence[dt.date] = field(default_factory=tuple)


def supervised(df: DataFrame, spec: SeriesSpec, params: SupervisedParams, cols: Sequence[str],
               stage: Callable[[DataFrame], DataFrame] = stage_table) -> DataFrame:
    """Gridded segments to training rows, numbered by day within each series.

    Smoothing and the lead target share one halo pass, hence one shuffle; the target is taken before
    the day filter, so a row at closing time still sees the value after it. Output: the keys,
    ``day_id``, ``slot``, the time column and ``cols`` (any of the inputs, ``target_ahead``,
    ``diff``, ``hours_sin/cos``, ``day_week_sin/cos``). No rows in, no rows out. The working-hours
    rows are staged, because whole days can only be told once all rows are counted.
    """
    w = halo_window(spec)
    half = params.kernel // 2
    out = with_halo(df, spec, half, params.ahead + half)
    out = out.withColumns({c: centred_mean(c, w, params.kernel) for c in params.smoothed})
    out = out.withColumns({
        "target_ahead": F.lead(params.target, params.ahead).over(w),
        "_ahead": F.lead(spec.slot, params.ahead).over(w)})
    out = drop_halo(out.where(F.col("_ahead").isNotNull()).drop("_ahead"))
    if params.difference:
        a, b = params.difference
        out = out.withColumn("diff", F.col(a) - F.col(b))
    out = out.withColumns(clock_features(spec.ts))
    out = drop_days(out, spec, params.removed_days)
    out = out.select(*spec.keys, spec.slot, spec.ts, *cols)
    out = numbered_working_days(out, spec, params.start, params.end, stage)
    return out.select(*spec.keys, "day_id", spec.slot, spec.ts, *cols)
