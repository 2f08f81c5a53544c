"""Daily decision tables: for all working days at once, profile, shifted correlation and spectrum."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from sensorweave.operators.calendar import day_slots, drop_days, numbered_working_days
from sensorweave.operators.dayshape import lag_corr, mean_over_days, spectrum
from sensorweave.operators.features import smooth
from sensorweave.sources.stage import stage as stage_table
from sensorweave.spec import SeriesSpec


def day_report(df: DataFrame, spec: SeriesSpec, xs: Sequence[str], y: str, *, start: str, end: str,
               max_shift: int, rate_hz: float, max_hz: float, circular: bool = False,
               smoothed: Sequence[str] = (), kernel: int = 5, removed_days=(),
               stage: Callable[[DataFrame], DataFrame] = stage_table) -> dict[str, DataFrame]:
    """The daily tables and their averages over days: ``profile``, ``corr``, ``freq`` and ``mean_*``.

    The day table behind them is staged once.
    """
    if smoothed:
        df = smooth(df, spec, smoothed, kernel)
    cols = [*xs, y]
    df = drop_days(df, spec, removed_days).select(*spec.keys, spec.ts, *cols)
    days = stage(day_slots(numbered_working_days(df, spec, start, end, stage), spec))
    corr = lag_corr(days, spec, xs, y, max_shift, circular)
    freq = spectrum(days, spec, cols, rate_hz, max_hz)
    profile = days.select(*spec.keys, "day_id", spec.slot, *cols)
    keys = list(spec.keys)
    return {
        "profile": profile, "corr": corr, "freq": freq,
        "mean_profile": mean_over_days(profile, [*keys, spec.slot], cols),
        "mean_corr": mean_over_days(corr, [*keys, "shift", "signal"], ["corr"]),
        "mean_freq": mean_over_days(freq, [*keys, "signal", "k"], ["freq", "mag"]),
    }
