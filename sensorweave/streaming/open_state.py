"""Segments and bins of a stream in a state of our own: closed by timer, late rows aside, the open tail at hand."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from sensorweave.spec import MICROS, SeriesSpec, from_micros, micros

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED, LATE, STATE = "closed", "late", "open"
_TIMES = ("lo", "hi", "n")
_STATS = ("sum", "min", "max", "known")


def _names(measures: Sequence[str]) -> list[str]:
    return [f"{c}_{s}" for c in measures for s in _STATS]


def _state_schema(measures: Sequence[str]) -> StructType:
    """Parallel arrays, one entry per open interval: at most lateness over gap (or step) of them, and one batch's."""
    return StructType([*[StructField(c, ArrayType(LongType())) for c in _TIMES],
                       *[StructField(c, ArrayType(DoubleType())) for c in _names(measures)]])


@dataclass(frozen=True)
class Rule:
    """Which rows belong together: those at most ``gap`` microseconds apart, or those of one bin of ``step``."""

    gap: int = 0
    step: int = 0

    def starts(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of intervals sorted by ``lo``: whether each opens a new group."""
        if self.step:
            own = lo // self.step
            return np.concatenate([[True], own[1:] != own[:-1]])
        return np.concatenate([[True], lo[1:] - np.maximum.accumulate(hi)[:-1] > self.gap])

    def closes(self, hi: np.ndarray) -> np.ndarray:
        """The watermark, in milliseconds, at which no further row can join."""
        end = (hi // self.step + 1) * self.step if self.step else hi + self.gap + 1
        return -(-end // 1000)


def merged(parts: pd.DataFrame, rule: Rule, measures: Sequence[str]) -> pd.DataFrame:
    """Intervals that belong together as one: an associative merge, whatever the order they came in."""
    if not len(parts):
        return parts
    parts = parts.sort_values("lo", kind="stable", ignore_index=True)
    group = np.cumsum(rule.starts(parts["lo"].to_numpy(), parts["hi"].to_numpy())) - 1
    how = {"lo": "min", "hi": "max", "n": "sum"}
    for c in measures:
        how |= {f"{c}_sum": "sum", f"{c}_min": "min", f"{c}_max": "max", f"{c}_known": "sum"}
    return parts.groupby(group).agg(how)


class OpenIntervals(StatefulProcessor):
    """Open intervals of one series. A timer at the earliest closing time emits what the watermark has passed."""

    def __init__(self, rule: Rule, keys: Sequence[str], measures: Sequence[str]):
        self.rule, self.keys, self.measures = rule, list(keys), list(measures)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState(STATE, _state_schema(self.measures))

    def _load(self) -> pd.DataFrame:
        columns = [*_TIMES, *_names(self.measures)]
        if not self.open.exists():
            return pd.DataFrame({c: np.zeros(0, np.int64 if c in _TIMES else np.float64) for c in columns})
        held = self.open.get()
        return pd.DataFrame({c: np.array(held[i], np.int64 if c in _TIMES else np.float64) for i, c in enumerate(columns)})

    def _keep(self, rows: pd.DataFrame) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not len(rows):
            self.open.clear()
            return
        self.open.update(tuple(rows[c].tolist() for c in rows.columns))
        self.handle.registerTimer(int(self.rule.closes(rows["hi"].to_numpy()).min()))

    def _out(self, key: tuple, kind: str, rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.reset_index(drop=True)
        for i, k in enumerate(self.keys):
            out.insert(i, k, [key[i]] * len(out))
        out.insert(len(self.keys), "kind", kind)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        now = self._load()
        for part in rows:
            t = part.iloc[:, len(self.keys)].to_numpy(np.int64)  # by place: names may be changed on the way
            fresh = pd.DataFrame({"lo": t, "hi": t, "n": np.ones(len(t), np.int64)})
            for i, c in enumerate(self.measures, len(self.keys) + 1):
                v = part.iloc[:, i].to_numpy(np.float64)
                known = ~np.isnan(v)
                fresh[f"{c}_sum"], fresh[f"{c}_min"], fresh[f"{c}_max"] = np.where(known, v, 0.0), v, v
                fresh[f"{c}_known"] = known.astype(np.float64)
            late = t < limit
            if late.any():
                yield self._out(key, LATE, fresh[late])
            now = merged(pd.concat([now, fresh[~late]], ignore_index=True), self.rule, self.measures)
        self._keep(now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._load()
        done = self.rule.closes(now["hi"].to_numpy()) <= timerValues.getCurrentWatermarkInMs()
        self._keep(now[~done])
        yield self._out(key, CLOSED, now[done])

    def close(self) -> None:
        pass


def _intervals(sdf: DataFrame, spec: SeriesSpec, rule: Rule, late: str, measures: Sequence[str]) -> DataFrame:
    sdf.sparkSession.conf.set(PROVIDER, ROCKSDB)  # the only store that holds timers
    # the clock is dropped after it has been watched, so that late rows reach the operator and are not lost
    clock = sdf.where(F.col(spec.ts).isNotNull()).withColumn("_clock", F.col(spec.ts).cast("timestamp")).withWatermark("_clock", late)
    rows = clock.select(*spec.keys, micros("_clock").alias("_t"), *[F.col(c).cast("double").alias(c) for c in measures])
    schema = StructType([*[rows.schema[k] for k in spec.keys], StructField("kind", StringType()),
                         *[StructField(c, LongType()) for c in _TIMES], *[StructField(c, DoubleType()) for c in _names(measures)]])
    return rows.groupBy(*spec.keys).transformWithStateInPandas(
        OpenIntervals(rule, spec.keys, measures), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def segment_intervals(sdf: DataFrame, spec: SeriesSpec, max_gap_s: float, late: str, measures: Sequence[str] = ()) -> DataFrame:
    """Gap segments of a stream (X1); ``late`` says how long rows out of order are waited for.

    One row per closed segment (``kind`` closed) with ``lo``, ``hi`` in microseconds, ``n`` and, per measure, sum,
    least, greatest and count of known values; one row per late row (``kind`` late). Rows exactly the gap apart
    stay together. Rows without a time are left out; a null key is a key. ``run_bounded`` collects the result.
    """
    return _intervals(sdf, spec, Rule(gap=int(round(max_gap_s * MICROS))), late, measures)


def bin_intervals(sdf: DataFrame, spec: SeriesSpec, step_s: float, late: str, measures: Sequence[str] = ()) -> DataFrame:
    """Bins of ``step_s`` seconds of a stream (X2), as ``segment_intervals``; ``lo`` and ``hi`` lie inside the bin."""
    return _intervals(sdf, spec, Rule(step=int(round(step_s * MICROS))), late, measures)


@dataclass(frozen=True)
class Bounded:
    """What a run over all data there is gave: closed intervals, late rows, and those still open in the state."""

    closed: DataFrame
    late: DataFrame
    open: DataFrame

    def all(self) -> DataFrame:
        return self.closed.unionByName(self.open)


def _shaped(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.withColumns({"start_ts": from_micros(F.col("lo")), "end_ts": from_micros(F.col("hi"))}).drop("lo", "hi").withColumnRenamed("n", "n_rows")


def open_tail(spark: SparkSession, checkpoint: str, spec: SeriesSpec) -> DataFrame:
    """The intervals that the state of a stopped run holds, read from its checkpoint; a later run goes on with them."""
    held = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    fields = [f.name for f in held.schema["value"].dataType.fields]
    zipped = F.arrays_zip(*[F.col(f"value.{c}").alias(c) for c in fields])
    rows = held.select(*[F.col(f"key.{k}").alias(k) for k in spec.keys], F.explode(zipped).alias("_i"))
    return _shaped(rows.select(*spec.keys, *[f"_i.{c}" for c in fields]), spec)


def run_bounded(intervals: DataFrame, spec: SeriesSpec, path: str, checkpoint: str) -> Bounded:
    """Process all data there is now, in as many micro-batches as the source gives, and stop.

    Closed intervals and late rows are appended below ``path``; a run that starts again from the same checkpoint
    goes on where the last one ended, and reads what all runs have written.
    """
    spark = intervals.sparkSession
    writer = (intervals.writeStream.format("parquet").partitionBy("kind").option("path", path)
              .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True))
    writer.start().awaitTermination()
    written = spark.read.schema(intervals.schema).parquet(path)
    closed, late = (_shaped(written.where(F.col("kind") == k).drop("kind"), spec) for k in (CLOSED, LATE))
    return Bounded(closed, late, open_tail(spark, checkpoint, spec).select(*closed.columns))
