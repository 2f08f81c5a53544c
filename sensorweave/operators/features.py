"""Fixed-offset features on a regular grid.

Each function makes one shuffle on ``(series, chunk)`` with a small halo of copied edge rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorweave.operators.ordered import drop_halo, halo_window, with_halo
from sensorweave.spec import SeriesSpec


def centred_mean(col: str, window, k: int) -> Column:
    """Moving mean over ``k`` rows around the row, series ends padded with the edge value.

    Null if any value in the window is null.
    """
    if k < 1 or k % 2 == 0:
        raise ValueError("kernel size must be odd")
    o = k // 2
    return _padded_mean(col, window, k, o, o)


def trailing_mean(col: str, window, k: int) -> Column:
    """Moving mean over the row and the ``k - 1`` before it, padded at the start."""
    return _padded_mean(col, window, k, k - 1, 0)


def _padded_mean(col: str, window, k: int, back: int, ahead: int) -> Column:
    frame = window.rowsBetween(-back, ahead)
    total = F.sum(col).over(frame)
    if back:
        missing = back - F.count(F.lit(1)).over(window.rowsBetween(-back, -1))
        total = total + missing * F.first(col).over(frame)
    if ahead:
        missing = ahead - F.count(F.lit(1)).over(window.rowsBetween(1, ahead))
        total = total + missing * F.last(col).over(frame)
    complete = F.count(col).over(frame) == F.count(F.lit(1)).over(frame)
    return F.when(complete, total / float(k))


def smooth(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], k: int = 5, mode: str = "centred") -> DataFrame:
    """Replace ``cols`` by their moving mean.

    ``centred`` (W10); ``trailing`` (W11); ``delay_corrected`` (W12): trailing, then every column but
    keys, slot and time moves ``k // 2`` rows back and the last ``k // 2`` rows of a series go. The
    published filter fixes k = 5 there; here ``k`` is honoured.
    """
    order = df.columns
    o = k // 2
    w = halo_window(spec)
    if mode == "centred":
        out = with_halo(df, spec, o, o).withColumns({c: centred_mean(c, w, k) for c in cols})
    elif mode == "trailing":
        out = with_halo(df, spec, k - 1, 0).withColumns({c: trailing_mean(c, w, k) for c in cols})
    elif mode == "delay_corrected":
        fixed = {*spec.keys, spec.slot, spec.ts, spec.chunk}
        moved = [c for c in order if c not in fixed]
        out = with_halo(df, spec, k - 1, o).withColumns({c: trailing_mean(c, w, k) for c in cols})
        if o:
            out = out.withColumn("_ahead", F.lead(spec.slot, o).over(w))
            out = out.withColumns({c: F.lead(c, o).over(w) for c in moved})
            out = out.where(F.col("_ahead").isNotNull())
    else:
        raise ValueError(f"unknown mode {mode}")
    return drop_halo(out).select(*order)


def lead_target(df: DataFrame, spec: SeriesSpec, col: str, rows: int, out: str) -> DataFrame:
    """Value ``rows`` ahead; rows without one (the last ``rows`` of a series) go."""
    w = halo_window(spec)
    df = with_halo(df, spec, 0, rows)
    df = df.withColumns({out: F.lead(col, rows).over(w), "_ahead": F.lead(spec.slot, rows).over(w)})
    return drop_halo(df.where(F.col("_ahead").isNotNull()).drop("_ahead"))


def lag_embed(df: DataFrame, spec: SeriesSpec, col: str, dim: int, delay: int,
              start: int | None = None, end: int | None = None) -> DataFrame:
    """``x(t-(dim-1)*delay) .. x(t)`` and the target ``x(t+delay)`` for slots in ``[start, end)``.

    Columns ``lag_<offset>`` and ``target`` (null where the series ends before it). Rows whose oldest
    lag lies before the series are dropped.
    """
    w = halo_window(spec)
    offsets = [d * delay for d in range(dim - 1, -1, -1)]
    df = with_halo(df, spec, offsets[0], delay)
    df = df.withColumns({
        **{f"lag_{o}": F.lag(col, o).over(w) for o in offsets},
        "_oldest": F.lag(spec.slot, offsets[0]).over(w), "target": F.lead(col, delay).over(w)})
    df = drop_halo(df.where(F.col("_oldest").isNotNull()).drop("_oldest"))
    if start is not None:
        df = df.where(F.col(spec.slot) >= start)
    if end is not None:
        df = df.where(F.col(spec.slot) < end)
    return df


def windows(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], target: str, length: int) -> DataFrame:
    """The ``length`` rows before each row as an array of feature rows, with that row's target.

    One output row per row that has ``length`` rows before it in its series, keyed by its own slot.
    Put a day into ``spec.keys`` to keep windows from crossing days. The windows overlap, so their
    rows are ``length`` times the input: build them last, next to their consumer.
    """
    w = halo_window(spec)
    df = with_halo(df, spec, length, 0)
    frame = w.rowsBetween(-length, -1)
    df = df.withColumn("window", F.collect_list(F.array(*[F.col(c) for c in cols])).over(frame))
    df = drop_halo(df.where(F.size("window") == length))
    return df.select(*spec.keys, spec.slot, "window", target)


def cyclic(value: Column, period: float, name: str) -> dict[str, Column]:
    """Sine and cosine of a cyclic quantity."""
    angle = value * (2.0 * math.pi) / period
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def clock_features(ts: str) -> dict[str, Column]:
    return {**cyclic(F.hour(ts), 24.0, "hours"), **cyclic(F.weekday(ts), 7.0, "day_week")}
