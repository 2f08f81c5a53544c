"""Streaming forms of segmentation and resampling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorweave.spec import SeriesSpec


def _timed(sdf: DataFrame, spec: SeriesSpec, late: str) -> DataFrame:
    return sdf.withColumn(spec.ts, F.col(spec.ts).cast("timestamp")).withWatermark(spec.ts, late)


def stream_segments(sdf: DataFrame, spec: SeriesSpec, max_gap_s: int, late: str = "1 hour",
                    values: Mapping[str, Column] | None = None) -> DataFrame:
    """Gap segments of a stream (X1): one row per finished segment with its first and last time.

    A segment is emitted once the watermark passes its end by the gap. Rows exactly ``max_gap_s``
    apart stay together, as in the batch form. Rows later than ``late`` are dropped.
    """
    t = F.col(spec.ts)
    # A session ends max_gap after its last row, end excluded: one more microsecond includes it.
    gap = F.session_window(t, f"{int(max_gap_s)} seconds 1 microseconds")
    aggs = {"start_ts": F.min(t), "end_ts": F.max(t), "n_rows": F.count(F.lit(1)), **(values or {})}
    out = _timed(sdf, spec, late).groupBy(*spec.keys, gap).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.drop("session_window").withColumns({
        "start_ts": F.col("start_ts").cast("timestamp_ntz"), "end_ts": F.col("end_ts").cast("timestamp_ntz")})


def stream_grid(sdf: DataFrame, spec: SeriesSpec, step_s: int, values: Mapping[str, Column], late: str = "1 hour") -> DataFrame:
    """Resampled bins of a stream (X2): one row per non-empty bin, emitted once the watermark passes it.

    Empty bins appear when the written table is read back on a dense grid (``operators.segments``).
    """
    t = F.col(spec.ts)
    out = _timed(sdf, spec, late).groupBy(*spec.keys, F.window(t, f"{int(step_s)} seconds").alias("_w")).agg(
        *[a.alias(n) for n, a in values.items()])
    return out.select(*spec.keys, F.col("_w.start").cast("timestamp_ntz").alias(spec.ts), *values)
