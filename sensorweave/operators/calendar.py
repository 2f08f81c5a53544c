"""Calendar filters, day tables and resampling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorweave.operators.ordered import join_keys
from sensorweave.spec import DAY_MICROS, SeriesSpec, null_safe


def time_range(df: DataFrame, spec: SeriesSpec, start: dt.datetime, end: dt.datetime,
               resolution: dt.timedelta = dt.timedelta(minutes=1)) -> DataFrame:
    """Rows from ``start`` to ``end``, both ends included; the end covers its whole resolution unit."""
    ts = F.col(spec.ts)
    return df.where((ts >= F.lit(start)) & (ts < F.lit(end + resolution)))


def drop_days(df: DataFrame, spec: SeriesSpec, days: Sequence[dt.date]) -> DataFrame:
    """Remove whole calendar days; days that do not occur change nothing (P5)."""
    if not days:
        return df
    return df.where(~F.to_date(spec.ts).isin([F.lit(d) for d in days]))


def seconds_of_day(ts: str | Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _seconds(clock: str) -> int:
    parts = [int(p) for p in clock.split(":")] + [0, 0]
    return parts[0] * 3600 + parts[1] * 60 + parts[2]


def between_time(df: DataFrame, spec: SeriesSpec, start: str, end: str) -> DataFrame:
    """Rows whose clock time lies in ``[start, end]`` (``HH:MM[:SS]``, P6); exact to the microsecond."""
    ts = F.col(spec.ts)
    of_day = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(DAY_MICROS))
    return df.where(of_day.between(_seconds(start) * 1_000_000, _seconds(end) * 1_000_000))


def weekdays_only(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Monday to Friday."""
    return df.where(F.weekday(spec.ts) < 5)


@null_safe
def weekday_blocks(df: DataFrame, spec: SeriesSpec, out: str = "block_id") -> DataFrame:
    """Drop weekends and number the weekday stretches between them, from 0 per series.

    Two weekday rows are in the same block when no weekend *row* lies between them. Days are the
    unit of work: whether a day is a weekend depends on its date alone.
    """
    keys = list(spec.keys)
    df = df.withColumn("_day", F.to_date(spec.ts))
    w = Window.partitionBy(*keys).orderBy("_day")
    days = df.select(*keys, "_day").distinct().withColumn("_work", F.weekday("_day") < 5)
    opens = F.col("_work") & ~F.coalesce(F.lag("_work").over(w), F.lit(False))
    days = days.withColumn(out, F.sum(opens.cast("long")).over(w) - 1).where("_work").drop("_work")
    return df.join(days, [*keys, "_day"]).drop("_day")


@null_safe
def full_days(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Keep days that have as many rows as the fullest day of the series."""
    keys = list(spec.keys)
    df = df.withColumn("_day", F.to_date(spec.ts))
    whole = Window.partitionBy(*keys)
    days = df.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n"))
    days = days.withColumn("_most", F.max("_n").over(whole)).where("_n = _most").select(*keys, "_day")
    return df.join(days, [*keys, "_day"], "left_semi").drop("_day")


def working_days(df: DataFrame, spec: SeriesSpec, start: str = "04:32", end: str = "18:30") -> DataFrame:
    """Working hours of weekdays, days of full length only."""
    return full_days(weekdays_only(between_time(df, spec, start, end), spec), spec)


@null_safe
def number_days(df: DataFrame, spec: SeriesSpec, out: str = "day_id") -> DataFrame:
    """Dense 0-based number over the days that occur in the series."""
    keys = list(spec.keys)
    df = df.withColumn("_day", F.to_date(spec.ts))
    w = Window.partitionBy(*keys).orderBy("_day")
    days = df.select(*keys, "_day").distinct().withColumn(out, (F.row_number().over(w) - 1).cast("int"))
    return df.join(days, [*keys, "_day"]).drop("_day")


@null_safe
def numbered_working_days(df: DataFrame, spec: SeriesSpec, start: str = "04:32", end: str = "18:30",
                          stage: Callable[[DataFrame], DataFrame] = lambda df: df, out: str = "day_id") -> DataFrame:
    """``working_days`` and ``number_days`` in one: a single day table decides what stays and its number.

    The filtered rows are read twice (to count days, then to keep them); ``stage`` may write them once.
    """
    keys = list(spec.keys)
    rows = stage(weekdays_only(between_time(df, spec, start, end), spec)).withColumn("_day", F.to_date(spec.ts))
    whole = Window.partitionBy(*keys)
    days = rows.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n"))
    days = days.withColumn("_most", F.max("_n").over(whole)).where("_n = _most")
    days = days.select(*keys, "_day", (F.row_number().over(whole.orderBy("_day")) - 1).cast("int").alias(out))
    return rows.join(days, [*keys, "_day"]).drop("_day")


def day_slots(df: DataFrame, spec: SeriesSpec, day: str = "day_id") -> DataFrame:
    """Row position inside each day (W24). A day on a grid has at most 86 400 / step rows."""
    w = Window.partitionBy(*spec.keys, day).orderBy(*spec.order)
    return df.withColumn(spec.slot, (F.row_number().over(w) - 1).cast("long"))


@null_safe
def nth_day(df: DataFrame, spec: SeriesSpec, n: int, day: str = "day_id") -> DataFrame:
    """The ``n``-th day of each series; negative ``n`` counts from the last day (T4)."""
    if n >= 0:
        return df.where(F.col(day) == n)
    last = df.groupBy(*spec.keys).agg(F.max(day).alias("_last"))
    days = last.select(*spec.keys, (F.col("_last") + 1 + n).alias(day))
    return df.join(F.broadcast(days), day) if not spec.keys else df.join(days, [*spec.keys, day])


def calendar_parts(ts: str) -> dict[str, Column]:
    """Day, weekday (Monday = 0), month, hour, minute (F2)."""
    return {"day": F.day(ts), "dayofweek": F.weekday(ts), "month": F.month(ts),
            "hour": F.hour(ts), "minute": F.minute(ts)}


def mean_by(df: DataFrame, parts: Mapping[str, Column], col: str, out: str = "mean") -> DataFrame:
    """Mean of ``col`` by calendar parts (A1, A2)."""
    return df.groupBy(*[c.alias(n) for n, c in parts.items()]).agg(F.avg(col).alias(out))


def month_weekday_matrix(df: DataFrame, spec: SeriesSpec, col: str) -> DataFrame:
    """Mean by month (rows) and weekday (columns ``d0`` .. ``d6``) (A3)."""
    wide = df.select(F.month(spec.ts).alias("month"), F.weekday(spec.ts).alias("_wd"), col)
    wide = wide.groupBy("month").pivot("_wd", list(range(7))).agg(F.avg(col))
    return wide.select("month", *[F.col(f"`{i}`").alias(f"d{i}") for i in range(7)])


def resample_aggregates(col: str, ts: str) -> dict[str, Column]:
    """The usual aggregates of a bin."""
    x = F.col(col)
    known = F.when(x.isNotNull(), F.col(ts))
    return {
        "sum": F.sum(x), "mean": F.avg(x), "std": F.stddev_samp(x),
        "sem": F.stddev_samp(x) / F.sqrt(F.count(x)), "max": F.max(x), "min": F.min(x),
        "first": F.min_by(x, known), "last": F.max_by(x, known),
        "open": F.min_by(x, known), "high": F.max(x), "low": F.min(x), "close": F.max_by(x, known),
    }


@null_safe
def resample_days(df: DataFrame, spec: SeriesSpec, days: int, aggs: Mapping[str, Column]) -> DataFrame:
    """Bins of ``days`` days counted from the first day of the series, empty bins kept as nulls (A5)."""
    keys = list(spec.keys)
    df = df.withColumn("_d", F.to_date(spec.ts))
    first = df.groupBy(*keys).agg(F.min("_d").alias("_from"), F.max("_d").alias("_to"))
    # The origin differs per series, so bins come from a join on (series, day).
    days_of = df.select(*keys, "_d").distinct()
    days_of = join_keys(days_of, first, keys).select(
        *keys, "_d", F.expr(f"date_add(_from, cast((datediff(_d, _from) div {int(days)}) * {int(days)} as int))").alias("bin"))
    sums = df.join(days_of, [*keys, "_d"]).groupBy(*keys, "bin").agg(*[a.alias(n) for n, a in aggs.items()])
    grid = first.select(*keys, F.explode(F.sequence("_from", "_to", F.expr(f"interval {int(days)} days"))).alias("bin"))
    return grid.join(sums, [*keys, "bin"], "left")


@null_safe
def resample_months(df: DataFrame, spec: SeriesSpec, aggs: Mapping[str, Column]) -> DataFrame:
    """Calendar months labelled by their last day, empty months kept as nulls."""
    keys = list(spec.keys)
    month = F.last_day(F.to_date(spec.ts)).alias("month_end")
    sums = df.groupBy(*keys, month).agg(*[a.alias(n) for n, a in aggs.items()])
    span = sums.groupBy(*keys).agg(F.min("month_end").alias("_a"), F.max("month_end").alias("_b"))
    first = F.trunc("_a", "month")
    months = span.select(*keys, F.explode(F.sequence(first, F.col("_b"), F.expr("interval 1 month"))).alias("_m"))
    grid = months.select(*keys, F.last_day("_m").alias("month_end"))
    return grid.join(sums, [*keys, "month_end"], "left")
