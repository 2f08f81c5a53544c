import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorweave import SeriesSpec
from sensorweave.operators import ordered
from sensorweave.operators.ordered import add_slot, bucket_width, minute_gaps, run_lengths
from sensorweave.operators.segments import (
    align_rate, grid_segments, interpolate, keep_long, largest_segment, resample, segment_by_gap, segments,
    split_on_null_runs,
)
from sensorweave.plans.cleaning import CleaningParams, clean
from tests.helpers import T0, close, gridded, minutes, pandas_interpolate, series, with_gaps

K = SeriesSpec(keys=("k",))
RAW = SeriesSpec(keys=("k",), tiebreak=("id",))


def raw(spark, times, key="a"):
    return spark.createDataFrame([(key, i, t, float(i)) for i, t in enumerate(times)], "k string, id long, ts timestamp_ntz, x double")


def test_gap_of_exactly_the_limit_does_not_split(spark):
    out = segment_by_gap(raw(spark, minutes(0, 30, 61)), RAW, 30 * 60)
    assert series(out, ["ts"], "segment_id") == [0, 0, 1]


@pytest.mark.parametrize("limit", [60, 600, 1800, 7200])
def test_segments_match_a_sorted_scan(spark, limit):
    rng = np.random.default_rng(limit)
    frames = []
    for key in "ab":
        t = np.sort(rng.integers(0, 3 * 86_400_000_000, 400))
        frames.append(pd.DataFrame({"k": key, "id": range(400), "ts": pd.Timestamp(T0) + pd.to_timedelta(t, "us"), "x": 0.0}))
    pdf = pd.concat(frames)
    pdf["want"] = pdf.groupby("k").ts.transform(lambda s: (s.diff().dt.total_seconds() > limit).cumsum())
    shuffled = pdf.sample(frac=1, random_state=1)
    got = segment_by_gap(spark.createDataFrame(shuffled), RAW, limit).toPandas()
    assert (got.segment_id == got.want).all()


def test_segment_bounds_and_unsorted_duplicates(spark):
    out = segments(raw(spark, minutes(100, 0, 0, 10)), RAW, 1800).orderBy("segment_id").collect()
    assert [(r.segment_id, r.start_ts, r.end_ts) for r in out] == [
        (0, T0, T0 + dt.timedelta(minutes=10)), (1, *[T0 + dt.timedelta(minutes=100)] * 2)]


def test_one_minute_grid_fills_the_gap(spark):
    df = raw(spark, minutes(8 * 60 + 24, 8 * 60 + 27))
    out = grid_segments(df, RAW, 60, 1800, {"x": F.avg("x")})
    assert series(out, ["slot"], "x") == [0.0, None, None, 1.0]


def test_grid_averages_rows_of_one_bin_and_restarts_per_segment(spark):
    out = grid_segments(raw(spark, minutes(0, 0.5, 2, 90)), RAW, 60, 1800, {"x": F.avg("x")})
    rows = [(r.segment_id, r.slot, r.x) for r in out.orderBy("segment_id", "slot").collect()]
    assert rows == [(0, 0, 0.5), (0, 1, None), (0, 2, 2.0), (1, 0, 3.0)]


def test_grid_needs_a_gap_of_at_least_the_step(spark):
    with pytest.raises(ValueError):
        grid_segments(raw(spark, minutes(0)), RAW, 60, 30, {"x": F.avg("x")})


def test_resample_spans_long_empty_stretches(spark, small_chunks):
    out = resample(raw(spark, minutes(3, 500)), RAW, 60, {"n": F.count("x")})
    assert out.count() == 498
    assert out.where("n > 0").count() == 2
    assert out.agg(F.min("slot"), F.max("slot")).first()[:] == (0, 497)


@pytest.mark.parametrize("values,phase", [([1, None, 2, None, 3], 0), ([None, 1, None, 2], 1), ([1, 2, 3, 4], 0)])
def test_phase_with_fewest_nulls_wins(spark, small_chunks, values, phase):
    out = align_rate(gridded(spark, values), K, 2, ["x"])
    want = values[phase::2]
    assert series(out, ["slot"], "x") == [None if v is None else float(v) for v in want]
    assert series(out, ["slot"], "slot") == list(range(len(want)))


def test_alignment_across_chunks(spark, small_chunks):
    rng = np.random.default_rng(0)
    values = with_gaps(rng, 101)
    for every in (2, 3, 5):
        nulls = [sum(v is None for v in values[p::every]) for p in range(every)]
        best = int(np.argmin(nulls))
        out = align_rate(gridded(spark, values), K, every, ["x"])
        assert series(out, ["slot"], "x") == values[best::every]
        assert all(r.chunk_id == r.slot // 8 for r in out.collect())


def test_null_run_split_golden(spark):
    values = [1, 2, None, None, None, 6, 7, 8, 9, 10, None, None, 13, 14]
    out = split_on_null_runs(gridded(spark, values), K, "x", 2)
    got = [(r.part_id, r.slot) for r in out.orderBy("slot").collect()]
    assert got == [(0, 0), (0, 1)] + [(5, s) for s in range(5, 14)]


def brute_split(values, limit):
    null = [v is None for v in values]
    out, i, n = [], 0, len(values)
    bad = [False] * n
    while i < n:
        j = i
        while j < n and null[j] == null[i]:
            j += 1
        if null[i] and j - i > limit:
            bad[i:j] = [True] * (j - i)
        i = j
    part = None
    for s in range(n):
        if bad[s]:
            part = None
        else:
            part = s if part is None else part
            out.append((part, s))
    return out


@pytest.mark.parametrize("limit", [0, 1, 3, 9, 20, 500])
@pytest.mark.parametrize("seed", range(4))
def test_null_run_split_matches_a_scan(spark, small_chunks, limit, seed):
    rng = np.random.default_rng(seed)
    values = with_gaps(rng, 97, p=0.5, run=25)
    if seed == 1:
        values[:12] = [None] * 12
    if seed == 2:
        values[-19:] = [None] * 19
    if seed == 3:
        values = [None] * 40
    out = split_on_null_runs(gridded(spark, values), K, "x", limit)
    assert [(r.part_id, r.slot) for r in out.orderBy("slot").collect()] == brute_split(values, limit)


def test_keep_long_is_strict(spark, small_chunks):
    df = gridded(spark, range(20)).unionByName(gridded(spark, range(21), key=("b",)))
    assert {r.k for r in keep_long(df, K, 20).collect()} == {"b"}


def test_interpolation_golden(spark):
    values = [None, None, 1, None, None, 4, 2, None, 8, None, None]
    out = interpolate(gridded(spark, values), K, ["x"])
    close(series(out, ["slot"], "x"), [None, None, 1, 2, 3, 4, 2, 5, 8, 8, 8])


@pytest.mark.parametrize("seed", range(3))
def test_interpolation_matches_pandas_across_chunks(spark, small_chunks, seed):
    rng = np.random.default_rng(seed)
    a, b = with_gaps(rng, 90, run=30), with_gaps(rng, 55, run=30)
    df = gridded(spark, a).unionByName(gridded(spark, b, key=("b",)))
    out = interpolate(df, K, ["x"])
    close(series(out.where("k = 'a'"), ["slot"], "x"), pandas_interpolate(a))
    close(series(out.where("k = 'b'"), ["slot"], "x"), pandas_interpolate(b))


def test_all_null_column_stays_null(spark, small_chunks):
    assert series(interpolate(gridded(spark, [None] * 20), K, ["x"]), ["slot"], "x") == [None] * 20


@pytest.mark.parametrize("seed", range(3))
def test_run_lengths_across_chunks(spark, small_chunks, seed):
    values = with_gaps(np.random.default_rng(seed), 70, run=30)
    flag = pd.Series([v is None for v in values])
    run = flag.ne(flag.shift()).cumsum()
    out = run_lengths(gridded(spark, values), K, F.col("x").isNull())
    assert series(out, ["slot"], "run_len") == run.groupby(run).transform("size").tolist()
    assert series(out, ["slot"], "run_start") == run.groupby(run).transform(lambda s: s.index[0]).tolist()


def test_minute_gaps_and_positions_across_buckets(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.integers(0, 10 * 3600, 200))
    times = [T0 + dt.timedelta(seconds=int(s)) for s in t]
    out = add_slot(minute_gaps(raw(spark, times), RAW), RAW)
    want = [None] + [(b - a) / 60 for a, b in zip(t, t[1:])]
    close(series(out, ["slot"], "gap_min"), want)
    assert series(out, ["ts", "id"], "slot") == list(range(200))


@pytest.mark.parametrize("levels", [2, 3])
def test_scans_of_several_levels_equal_one_window(spark, monkeypatch, small_chunks, levels):
    """Tiny spans, so that a short series crosses many of them; every operator that carries facts along a series."""
    monkeypatch.setattr(ordered, "FAN", 3)
    rng = np.random.default_rng(levels)
    t = np.cumsum(rng.choice([1, 5, 31, 400], 160))
    df = raw(spark, minutes(*t)).unionByName(raw(spark, minutes(*t[:50])).withColumn("k", F.lit(None).cast("string")))
    long = replace(RAW, levels=levels)
    grid = gridded(spark, with_gaps(rng, 300), key=(None,))
    key, gkey = lambda r: str(r), SeriesSpec(keys=("k",))
    for run in (lambda s, g: add_slot(df, s, 600), lambda s, g: minute_gaps(df, s, bucket_seconds=600), lambda s, g: segment_by_gap(df, s, 1800),
                lambda s, g: segments(df, s, 1800), lambda s, g: grid_segments(df, s, 60, 1800, {"x": F.avg("x")}),
                lambda s, g: split_on_null_runs(grid, g, "x", 3), lambda s, g: interpolate(grid, g, ["x"]),
                lambda s, g: run_lengths(grid, g, F.col("x").isNull())):
        one, many = run(RAW, gkey), run(long, replace(gkey, levels=levels))
        assert sorted(one.collect(), key=key) == sorted(many.collect(), key=key)


def test_no_window_orders_a_whole_series_at_two_levels(spark):
    df = raw(spark, minutes(0, 1, 2))
    plan = segment_by_gap(df, replace(RAW, levels=2), 1800)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert windows and sum("_span2" in w for w in windows) >= 2  # the others order spans, not cells
    assert all("_span2" in w for w in windows if "_cell" in w)


def test_bucket_width_adapts_to_a_burst(spark):
    burst = raw(spark, [T0 + dt.timedelta(seconds=i / 10) for i in range(600)] + minutes(5, 4000))
    assert bucket_width(burst, RAW, 1000) == 86_400
    assert bucket_width(burst, RAW, 150) == 10
    assert bucket_width(burst, RAW, 1) == 1
    out = minute_gaps(burst, RAW, bucket_seconds=10)
    assert out.where("gap_min IS NULL").count() == 1
    assert np.isclose(out.agg(F.sum("gap_min")).first()[0], 4000)
    assert sorted(minute_gaps(burst, RAW, bucket_seconds=None).collect()) == sorted(out.collect())


def reference_clean(times, x, y, p):
    """The cleaning steps one after the other in pandas, for a single series."""
    df = pd.DataFrame({"x": x, "y": y}, index=pd.DatetimeIndex(times))
    seg = (df.index.to_series().diff().dt.total_seconds() > p.max_gap_s).cumsum().to_numpy()
    out = []
    for s in np.unique(seg):
        grid = df[seg == s].resample(f"{p.step_s}s").mean()
        nulls = [grid.iloc[i::p.every].isnull().sum().sum() for i in range(p.every)]
        cut = grid.iloc[int(np.argmin(nulls))::p.every]
        null = cut.y.isna()
        run = null.ne(null.shift()).cumsum()
        bad = null & (run.groupby(run).transform("size") > p.max_null_run)
        part = bad.ne(bad.shift()).cumsum()
        for _, g in cut.groupby(part):
            if not bad[g.index[0]] and len(g) > p.min_rows:
                out.append(g.interpolate("linear"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cleaning_matches_step_by_step_pandas(spark, small_chunks, seed):
    rng = np.random.default_rng(seed)
    steps = rng.choice([1, 1, 1, 1, 2, 3, 40], size=400)
    t = np.cumsum(steps)
    times = [T0 + dt.timedelta(minutes=int(m)) for m in t]
    x = np.where(rng.random(400) < 0.3, np.nan, rng.normal(size=400).round(3))
    y = np.where((t % 2 == 0) & (rng.random(400) < 0.8), rng.normal(size=400).round(3), np.nan)
    p = CleaningParams(step_s=60, max_gap_s=1800, every=2, max_null_run=2, min_rows=6)
    want = reference_clean(times, x, y, p)
    rows = [("a", ts, None if np.isnan(a) else float(a), None if np.isnan(b) else float(b)) for ts, a, b in zip(times, x, y)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, x double, y double")
    got = clean(df, K, ["x", "y"], "y", p).toPandas().sort_values(["ts"])
    parts = [g for _, g in got.groupby(["segment_id", "part_id"])]
    assert len(want) > 2 and len(parts) == len(want)
    for g, w in zip(parts, want):
        assert list(g.ts) == list(w.index)
        assert list(g.slot) == list(range(len(w)))
        np.testing.assert_allclose(g[["x", "y"]].to_numpy(), w.to_numpy(), atol=1e-9)


def test_cleaning_is_the_same_lazy_or_staged(spark, small_chunks):
    df = gridded(spark, with_gaps(np.random.default_rng(2), 200)).drop("slot")
    p = CleaningParams(min_rows=4, max_null_run=3)
    staged = clean(df, K, ["x"], "x", p).orderBy("ts").collect()
    lazy = clean(df, K, ["x"], "x", p, stage=lambda d: d).orderBy("ts").collect()
    assert staged == lazy and staged


def test_empty_input_gives_an_empty_frame(spark):
    df = raw(spark, minutes(0)).where("false")
    out = clean(df, RAW, ["x"], "x", CleaningParams())
    assert out.columns == ["k", "segment_id", "part_id", "slot", "ts", "x"] and out.count() == 0


def test_single_row(spark):
    out = clean(raw(spark, minutes(0)), RAW, ["x"], "x", CleaningParams(min_rows=0))
    assert [(r.slot, r.x) for r in out.collect()] == [(0, 0.0)]


def test_largest_segment_ties_to_lowest(spark):
    df = grid_segments(raw(spark, minutes(0, 1, 100, 101, 200)), RAW, 60, 1800, {"x": F.avg("x")})
    assert largest_segment(df, RAW.within("segment_id")).collect()[0][:] == ("a", 0, 2)
