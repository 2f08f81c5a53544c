"""The cleaning plan: irregular multi-rate rows to gap-free, null-free segments."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.operators.segments import (
    SEGMENT, align_rate, attach_parts, best_phase, grid_segments, interpolate, null_free_parts,
)
from sensorweave.sources.stage import stage as stage_table
from sensorweave.spec import SeriesSpec, null_safe


@dataclass(frozen=True)
class CleaningParams:
    """One-minute grid, half-hour gaps and null runs, every second row, a thousand rows at least."""

    step_s: int = 60
    max_gap_s: int = 30 * 60
    every: int = 2
    max_null_run: int = 30
    min_rows: int = 1000


@null_safe
def clean(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], target: str,
          params: CleaningParams = CleaningParams(),
          stage: Callable[[DataFrame], DataFrame] = stage_table) -> DataFrame:
    """Segment, grid, align, split, keep long, interpolate.

    Output: ``keys, segment_id, part_id, slot, ts, *cols``; ``slot`` restarts at 0 in each part.

    The gridded table and the two small fact tables (best phase, kept parts) are read more than
    once, so each is staged: written once, then scanned with only the columns needed. That runs three
    jobs; pass ``stage=lambda df: df`` for one lazy plan that recomputes instead.
    """
    seg = spec.within(SEGMENT)
    part = seg.within("part_id")
    grid = stage(grid_segments(df, spec, params.step_s, params.max_gap_s, {c: F.avg(c) for c in cols}))
    best = stage(best_phase(grid, seg, params.every, cols))
    aligned = align_rate(grid, seg, params.every, cols, best)
    parts = null_free_parts(aligned, seg, target, params.max_null_run)
    parts = stage(parts.where(F.col("_hi_slot") - F.col("part_id") + 1 > params.min_rows))
    out = interpolate(attach_parts(aligned, seg, parts), part, cols, cluster=seg.keys)
    return out.select(*part.keys, (F.col(spec.slot) - F.col("part_id")).alias(spec.slot), spec.ts, *cols)
