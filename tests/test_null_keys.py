"""A null series key names a series like any other, in every operator that joins on the keys."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorweave import SeriesSpec
from sensorweave.operators import calendar as C
from sensorweave.operators import diagnostics as D
from sensorweave.operators import ordered as O
from sensorweave.operators import segments as S
from sensorweave.operators.quantiles import exact_quantiles
from sensorweave.plans.cleaning import CleaningParams, clean

SPEC = SeriesSpec(keys=("site", "room"))


@pytest.fixture(scope="module")
def rows(spark):
    """One series of 40 half-hours from a Monday on, under a whole and under a half-null key."""
    start = dt.datetime(2024, 1, 8)
    times = [start + dt.timedelta(minutes=30 * i) for i in range(40)]
    data = [(site, room, t, float(i % 7)) for site, room in (("a", "b"), ("a", None), (None, None)) for i, t in enumerate(times)]
    return spark.createDataFrame(data, "site string, room string, ts timestamp_ntz, x double")


def agree(df, n_keys=3):
    """Every series gives the same rows."""
    assert {"site", "room"} <= set(df.columns)
    found: dict = {}
    for r in df.collect():
        r = r.asDict()
        found.setdefault((r.pop("site"), r.pop("room")), []).append(tuple(sorted((k, str(round(v, 9) if isinstance(v, float) else v)) for k, v in r.items())))
    assert len(found) == n_keys
    first, *others = [sorted(v) for v in found.values()]
    assert first and all(o == first for o in others)


@pytest.mark.parametrize("op", [
    lambda d: O.add_slot(d, SPEC),
    lambda d: O.minute_gaps(d, SPEC, bucket_seconds=7200),
    lambda d: S.segment_by_gap(d, SPEC, 600),
    lambda d: S.resample(d, SPEC, 600, {"x": F.avg("x")}),
    lambda d: C.weekday_blocks(d, SPEC),
    lambda d: C.full_days(d, SPEC),
    lambda d: C.number_days(d, SPEC),
    lambda d: C.working_days(d, SPEC),
    lambda d: C.numbered_working_days(d, SPEC),
    lambda d: C.nth_day(C.number_days(d, SPEC), SPEC, -1),
    lambda d: C.resample_days(d, SPEC, 1, {"x": F.sum("x")}),
    lambda d: C.resample_months(d, SPEC, {"x": F.sum("x")}),
    lambda d: D.gap_histogram(d, SPEC),
    lambda d: D.context_rows(d, SPEC, 20, 1),
    lambda d: exact_quantiles(d, "x", [0.5, 0.9], ["site", "room"]),
    lambda d: D.dispersion(d.withColumn("f", F.array("x")), "f", ["site", "room"]),
])
def test_raw_operators(rows, op):
    agree(op(rows))


@pytest.mark.parametrize("op", [
    lambda d: O.run_lengths(d, SPEC, F.col("x") > 3),
    lambda d: O.nearest_known(d.withColumn("chunk_id", F.expr("slot div 8")), SPEC, {"v": F.when(F.col("slot") % 9 == 4, F.col("x"))}),
    lambda d: S.align_rate(d, SPEC, 2, ["x"]),
    lambda d: S.split_on_null_runs(d.withColumn("x", F.when(~F.col("slot").between(10, 15), F.col("x"))), SPEC, "x", 3),
    lambda d: S.keep_long(d, SPEC, 5),
    lambda d: S.interpolate(d.withColumn("x", F.when(F.col("slot") % 3 > 0, F.col("x"))), SPEC, ["x"]),
])
def test_grid_operators(rows, op):
    agree(op(S.resample(rows, SPEC, 1800, {"x": F.avg("x")})))


def test_clean(rows):
    params = CleaningParams(step_s=1800, max_gap_s=3600, every=1, max_null_run=2, min_rows=5)
    agree(clean(rows, SPEC, ["x"], "x", params))


def test_key_values_come_back(rows):
    out = O.add_slot(rows, SPEC)
    assert out.schema["site"].dataType == rows.schema["site"].dataType and out.count() == rows.count()
