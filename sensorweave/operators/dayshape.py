"""Per-day diagnostics: shifted correlation, amplitude spectrum, mean day.

All of them start from one row per (series, day) that holds the day's signals as arrays. A day on a
grid has at most 86 400 / step rows, so that row is bounded whatever the size of the series; the
arrays are made by one shuffle and handed to NumPy in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.spec import SeriesSpec


def day_arrays(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], day: str = "day_id") -> DataFrame:
    """One row per (series, day): each signal as an array in slot order, nulls kept."""
    rows = F.sort_array(F.collect_list(F.struct(spec.slot, *[F.col(c).cast("double").alias(c) for c in cols])))
    packed = df.groupBy(*spec.keys, day).agg(rows.alias("_rows"))
    return packed.select(*spec.keys, day, *[F.col(f"_rows.{c}").alias(c) for c in cols])


def _signals(batch, name: str) -> list[np.ndarray]:
    """The arrays of one column of a batch, nulls as NaN, without a Python object per value."""
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def shifted_corr(x: np.ndarray, y: np.ndarray, max_shift: int, circular: bool) -> list[float | None]:
    """Pearson correlation of ``x`` moved ``shift`` rows later with ``y``, pairs with a null left out.

    The sums for all shifts come from matrix products; shifts whose variance the sums cannot tell
    from zero are done over from the pairs themselves.
    """
    n = len(x)
    x_known, y_known = ~np.isnan(x), ~np.isnan(y)
    if not (x_known.any() and y_known.any()):
        return [None] * max_shift
    x0 = np.where(x_known, x - x[x_known].mean(), 0.0)
    y0 = np.where(y_known, y - y[y_known].mean(), 0.0)
    at = np.arange(n)[None, :] - np.arange(max_shift)[:, None]
    inside = np.ones(at.shape, bool) if circular else at >= 0
    at = at % n
    lag_known = x_known[at] & inside
    lag = np.where(lag_known, x0[at], 0.0)
    target = np.column_stack([y_known.astype(float), y0, y0 * y0])
    count, sy, syy = (lag_known.astype(float) @ target).T
    sx, sxy, _ = (lag @ target).T
    sxx = (lag * lag) @ target[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = sxx - sx * sx / count, syy - sy * sy / count
        corr = (sxy - sx * sy / count) / np.sqrt(vx * vy)
    weak = ~((vx > 1e-8 * sxx) & (vy > 1e-8 * syy))
    out: list[float | None] = []
    for shift in range(max_shift):
        if count[shift] < 2:
            out.append(None)
        elif weak[shift]:
            out.append(_pair_corr(x[at[shift]][inside[shift]], y[inside[shift]]))
        else:
            out.append(float(corr[shift]))
    return out


def _pair_corr(a: np.ndarray, b: np.ndarray) -> float | None:
    both = ~(np.isnan(a) | np.isnan(b))
    a, b = a[both], b[both]
    if len(a) < 2 or (a == a[0]).all() or (b == b[0]).all():
        return None
    a, b = a - a.mean(), b - b.mean()
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def _key_fields(df: DataFrame, names: Sequence[str], outputs: Sequence[str]) -> list[T.StructField]:
    clash = set(names) & set(outputs)
    if clash:
        raise ValueError(f"key columns clash with output columns: {', '.join(sorted(clash))}")
    return [df.schema[n] for n in names]


def lag_corr(df: DataFrame, spec: SeriesSpec, xs: Sequence[str], y: str, max_shift: int,
             circular: bool = False, day: str = "day_id") -> DataFrame:
    """Correlation of each signal, moved 0 .. ``max_shift`` - 1 rows later, with ``y`` per day.

    Long form: keys, day, ``shift``, ``signal``, ``corr``. A constant signal gives null.
    """
    packed = day_arrays(df, spec, [*xs, y], day)
    ids = [*spec.keys, day]
    schema = T.StructType([*_key_fields(packed, ids, ["shift", "signal", "corr"]), T.StructField("shift", T.IntegerType()),
                           T.StructField("signal", T.StringType()), T.StructField("corr", T.DoubleType())])
    names = list(xs)

    def run(batches):
        for batch in batches:
            index, shifts, signals, values = [], [], [], []
            columns = {c: _signals(batch, c) for c in [*names, y]}
            for i in range(batch.num_rows):
                target = columns[y][i]
                for name in names:
                    corr = shifted_corr(columns[name][i], target, max_shift, circular)
                    index += [i] * max_shift
                    shifts += range(max_shift)
                    signals += [name] * max_shift
                    values += corr
            taken = batch.select(ids).take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(shifts, pa.int32()), pa.array(signals, pa.string()),
                 pa.array(values, pa.float64())], names=[*ids, "shift", "signal", "corr"])

    return packed.mapInArrow(run, schema)


def best_lag(corrs: DataFrame, spec: SeriesSpec, day: str = "day_id") -> DataFrame:
    """The shift with the strongest correlation per signal, ties to the smallest shift."""
    strength = F.when(F.col("corr").isNotNull(), F.struct(F.abs("corr").alias("a"), (-F.col("shift")).alias("b"),
                                                          F.col("corr").alias("c")))
    best = corrs.groupBy(*spec.keys, day, "signal").agg(F.max(strength).alias("_m"))
    return best.select(*spec.keys, day, "signal", (-F.col("_m.b")).alias("shift"), F.col("_m.c").alias("corr"))


def spectrum(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], rate_hz: float, max_hz: float,
             day: str = "day_id") -> DataFrame:
    """Amplitude spectrum per day and signal (W21): zero frequency set to 0, bins below ``max_hz``.

    Long form: keys, day, ``signal``, ``k``, ``freq``, ``mag``. One null in a day makes all its
    magnitudes of that signal null.
    """
    packed = day_arrays(df, spec, cols, day)
    ids = [*spec.keys, day]
    schema = T.StructType([*_key_fields(packed, ids, ["signal", "k", "freq", "mag"]), T.StructField("signal", T.StringType()),
                           T.StructField("k", T.IntegerType()), T.StructField("freq", T.DoubleType()),
                           T.StructField("mag", T.DoubleType())])
    names = list(cols)

    def run(batches):
        for batch in batches:
            index, signals, ks, freqs, mags = [], [], [], [], []
            for name in names:
                for i, x in enumerate(_signals(batch, name)):
                    n = len(x)
                    freq = np.arange(n // 2) * rate_hz / n if n else np.zeros(0)
                    freq = freq[freq < max_hz]
                    if np.isnan(x).any():
                        mag = [None] * len(freq)
                    else:
                        mag = np.abs(np.fft.rfft(x))[: len(freq)]
                        mag[:1] = 0.0
                        mag = mag.tolist()
                    index += [i] * len(freq)
                    signals += [name] * len(freq)
                    ks += range(len(freq))
                    freqs += freq.tolist()
                    mags += mag
            taken = batch.select(ids).take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(signals, pa.string()), pa.array(ks, pa.int32()),
                 pa.array(freqs, pa.float64()), pa.array(mags, pa.float64())],
                names=[*ids, "signal", "k", "freq", "mag"])

    return packed.mapInArrow(run, schema)


def period_hours(freq: Column) -> Column:
    """Hours per cycle, null at frequency 0."""
    return F.when(freq != 0, 1.0 / freq / 3600.0)


def elapsed(slot: Column, step_min: float) -> dict[str, Column]:
    """Elapsed minutes, hours and days from the row position."""
    minutes = slot * step_min
    return {"minutes": minutes, "hours": minutes / 60.0, "days": minutes / 60.0 / 24.0}


def mean_over_days(df: DataFrame, position: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Average of daily tables by row position (slot, shift or k)."""
    return df.groupBy(*position).agg(*[F.avg(c).alias(c) for c in cols])
