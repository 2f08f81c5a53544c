import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorweave import SeriesSpec
from sensorweave.functions.scaling import Scaler, fold_stats, minmax_given, standard_given
from sensorweave.operators.calendar import (
    between_time, drop_days, full_days, nth_day, number_days, numbered_working_days, resample_days, resample_months,
    time_range, weekday_blocks, working_days,
)
from sensorweave.operators.dayshape import best_lag, lag_corr, shifted_corr, spectrum
from sensorweave.operators.diagnostics import column_stats, context_rows, corr_matrix, dispersion
from sensorweave.operators.features import lag_embed, lead_target, smooth, windows
from sensorweave.operators.quantiles import column_quantiles, exact_quantiles, sortable
from tests.helpers import T0, close, gridded, minutes, series, with_gaps

K = SeriesSpec(keys=("k",))


def pad_mean(x, k, back, ahead):
    x = np.array([np.nan if v is None else v for v in x])
    out = np.convolve(np.pad(x, (back, ahead), "edge"), np.ones(k) / k, "valid")
    return [None if np.isnan(v) else float(v) for v in out]


def test_centred_average_golden(spark):
    out = smooth(gridded(spark, range(1, 10)), K, ["x"], 5)
    close(series(out, ["slot"], "x"), [1.6, 2.2, 3, 4, 5, 6, 7, 7.8, 8.4])


def test_trailing_average_golden(spark):
    out = smooth(gridded(spark, range(1, 10)), K, ["x"], 5, "trailing")
    close(series(out, ["slot"], "x"), [1, 1.2, 1.6, 2.2, 3, 4, 5, 6, 7])


@pytest.mark.parametrize("k", [1, 3, 7, 15])
def test_averages_across_chunks(spark, small_chunks, k):
    x = [float(v) for v in np.random.default_rng(k).normal(size=60)]
    df = gridded(spark, x).unionByName(gridded(spark, x[::-1][:33], key=("b",)))
    o = k // 2
    for key, v in (("a", x), ("b", x[::-1][:33])):
        part = df.where(F.col("k") == key)
        close(series(smooth(part, K, ["x"], k), ["slot"], "x"), pad_mean(v, k, o, o))
        trail = pad_mean(v, k, k - 1, 0)
        close(series(smooth(part, K, ["x"], k, "trailing"), ["slot"], "x"), trail)
        close(series(smooth(part, K, ["x"], k, "delay_corrected"), ["slot"], "x"), trail[o:])


def test_nulls_spread_over_their_windows(spark, small_chunks):
    x = with_gaps(np.random.default_rng(1), 40)
    close(series(smooth(gridded(spark, x), K, ["x"], 5), ["slot"], "x"), pad_mean(x, 5, 2, 2))


def test_even_kernel_is_refused(spark):
    with pytest.raises(ValueError):
        smooth(gridded(spark, [1, 2]), K, ["x"], 4)


def test_lead_target_drops_the_tail(spark, small_chunks):
    out = lead_target(gridded(spark, range(30)), K, "x", 11, "y")
    assert series(out, ["slot"], "y") == [float(v) for v in range(11, 30)]


def test_lag_embedding_rows(spark, small_chunks):
    df = gridded(spark, range(1201))
    out = lag_embed(df, K, "x", 4, 6, 118, 1118).orderBy("slot")
    first = out.first()
    assert out.count() == 1000
    assert [first[c] for c in ("lag_18", "lag_12", "lag_6", "lag_0", "target")] == [100, 106, 112, 118, 124]


def test_lag_embedding_target_beyond_the_end_is_null(spark, small_chunks):
    out = lag_embed(gridded(spark, range(20)), K, "x", 2, 3)
    assert series(out, ["slot"], "slot") == list(range(3, 20))
    assert series(out, ["slot"], "target") == [float(v) for v in range(6, 20)] + [None] * 3


def test_windows_hold_the_rows_before(spark, small_chunks):
    out = windows(gridded(spark, range(20)), K, ["x"], "x", 9).orderBy("slot").collect()
    assert len(out) == 11
    for r in out:
        assert [v[0] for v in r.window] == [float(v) for v in range(r.slot - 9, r.slot)] and r.x == r.slot


# --- calendar ---------------------------------------------------------------------------------------

def hourly(spark, n, start=T0, key="a"):
    rows = [(key, start + dt.timedelta(hours=i), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, x double")


def test_weekday_numbers_start_on_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2022, 5, 25),)], "ts timestamp_ntz")
    assert df.select(F.weekday("ts")).first()[0] == 2


def test_range_end_covers_its_minute(spark):
    df = spark.createDataFrame([(t,) for t in minutes(0, 1, 1.5, 2)], "ts timestamp_ntz")
    assert time_range(df, SeriesSpec(), T0, T0 + dt.timedelta(minutes=1)).count() == 3


def test_between_time_is_exact_at_both_ends(spark):
    day = dt.datetime(2024, 1, 1, 18, 30)
    df = spark.createDataFrame([(day,), (day + dt.timedelta(microseconds=1),), (dt.datetime(2024, 1, 1, 4, 32),)], "ts timestamp_ntz")
    assert between_time(df, SeriesSpec(), "04:32", "18:30").count() == 2


def test_drop_days_ignores_absent_days(spark):
    df = hourly(spark, 48)
    assert drop_days(df, K, [dt.date(2024, 1, 2)]).count() == 24
    assert drop_days(df, K, [dt.date(1999, 1, 1)]).count() == 48


def test_weekday_blocks_number_the_weeks(spark):
    out = weekday_blocks(hourly(spark, 24 * 15), K)
    assert [r[:] for r in out.groupBy("block_id").count().orderBy("block_id").collect()] == [(0, 120), (1, 120), (2, 24)]


def test_only_days_of_full_length_stay(spark):
    df = hourly(spark, 24 * 7 + 5).where("x != 30")
    out = working_days(df, K, "05:00", "17:00")
    assert sorted({r.d for r in out.select(F.to_date("ts").alias("d")).collect()}) == [
        dt.date(2024, 1, i) for i in (1, 3, 4, 5)]
    fused = numbered_working_days(df, K, "05:00", "17:00").drop("day_id")
    assert sorted(fused.collect()) == sorted(out.collect())
    assert full_days(df.where("false"), K).count() == 0


def test_day_numbers_are_dense_per_series(spark):
    df = hourly(spark, 24 * 3).where("x < 24 OR x >= 48").unionByName(hourly(spark, 24, key="b"))
    out = number_days(df, K)
    assert {(r.k, r.day_id) for r in out.select("k", "day_id").distinct().collect()} == {("a", 0), ("a", 1), ("b", 0)}
    assert nth_day(out, K, -1).where("k = 'a'").agg(F.min("x")).first()[0] == 48.0


def test_day_bins_start_at_the_first_day_and_stay_dense(spark):
    df = hourly(spark, 24 * 11).where("x < 24 OR x >= 216")
    out = resample_days(df, K, 3, {"n": F.count("x")}).orderBy("bin").collect()
    assert [(r.bin.day, r.n) for r in out] == [(1, 24), (4, None), (7, None), (10, 48)]


def test_months_are_labelled_by_their_end(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 31), 1.0), ("a", dt.datetime(2024, 4, 1), 3.0)], "k string, ts timestamp_ntz, x double")
    out = resample_months(df, K, {"m": F.avg("x")}).orderBy("month_end").collect()
    assert [(r.month_end, r.m) for r in out] == [
        (dt.date(2024, 1, 31), 1.0), (dt.date(2024, 2, 29), None), (dt.date(2024, 3, 31), None), (dt.date(2024, 4, 30), 3.0)]


# --- per-day diagnostics ------------------------------------------------------------------------------

D = SeriesSpec()


def days_frame(spark, days):
    rows = [(d, i, *[None if v is None or np.isnan(v) else float(v) for v in r]) for d, m in enumerate(days) for i, r in enumerate(m)]
    return spark.createDataFrame(rows, "day_id int, slot long, x double, y double")


@pytest.mark.parametrize("circular", [False, True])
def test_shifted_correlation_matches_pandas(spark, circular):
    rng = np.random.default_rng(3)
    days = [rng.normal(size=(40, 2)), rng.normal(size=(33, 2))]
    days[1][4, 0] = np.nan
    got = lag_corr(days_frame(spark, days), D, ["x"], "y", 12, circular)
    for d, m in enumerate(days):
        x, y = pd.Series(m[:, 0]), pd.Series(m[:, 1])
        want = [(pd.Series(np.roll(x, s)) if circular else x.shift(s)).corr(y) for s in range(12)]
        close(series(got.where(f"day_id = {d}"), ["shift"], "corr"), want)


def test_best_lag_finds_a_planted_delay(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    frame = days_frame(spark, [np.column_stack([x, np.roll(x, 7)])])
    assert best_lag(lag_corr(frame, D, ["x"], "y", 20, True), D).first()["shift"] == 7


def test_shift_beyond_the_series_is_null():
    assert shifted_corr(np.arange(3.0), np.arange(3.0), 5, False)[2:] == [None, None, None]


@pytest.mark.parametrize("circular", [False, True])
def test_shifted_correlation_with_many_nulls_and_flat_stretches(circular):
    rng = np.random.default_rng(9)
    for trial in range(30):
        x, y = rng.normal(size=25).round(1) + 1e3, rng.normal(size=25).round(1)
        x[rng.random(25) < 0.4] = np.nan
        x[8:20] = 7.0 if trial % 2 else x[8:20]
        y[rng.random(25) < 0.3] = np.nan
        y[:20] = 1.0 if trial % 3 == 0 else y[:20]
        px, py = pd.Series(x), pd.Series(y)
        for s, got in enumerate(shifted_corr(x, y, 30, circular)):
            moved = pd.Series(np.roll(x, s)) if circular else px.shift(s)
            pair = pd.DataFrame({"a": moved, "b": py}).dropna()
            if len(pair) < 2 or pair.a.nunique() < 2 or pair.b.nunique() < 2:
                assert got is None
            else:
                assert np.isclose(got, np.corrcoef(pair.a, pair.b)[0, 1], atol=1e-8)


def test_spectrum_matches_fft(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(50, 2))
    m2 = m.copy()
    m2[3, 1] = np.nan
    out = spectrum(days_frame(spark, [m, m2]), D, ["x", "y"], 1 / 120, 0.0015)
    mag = np.abs(np.fft.fft(m[:, 0]))
    mag[0] = 0
    freq = np.fft.fftfreq(50, 120)[:25]
    keep = freq < 0.0015
    first = out.where("day_id = 0 AND signal = 'x'")
    close(series(first, ["k"], "mag"), mag[:25][keep].tolist())
    close(series(first, ["k"], "freq"), freq[keep].tolist())
    assert set(series(out.where("day_id = 1 AND signal = 'y'"), ["k"], "mag")) == {None}


# --- reports and scaling ------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles_with_ties_and_groups(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(3000) < 0.4, 1.0, rng.normal(size=3000).round(2 + seed))
    g = np.where(rng.random(3000) < 0.8, 0, rng.integers(1, 4, 3000))
    pdf = pd.DataFrame({"g": g, "x": x})
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), "x", qs, ["g"]).toPandas().set_index(["g", "p"]).q
    for key, part in pdf.groupby("g"):
        for q in qs:
            assert np.isclose(got[key, q], np.quantile(part.x, q))


def test_quantiles_of_one_value_and_of_nulls(spark):
    df = spark.createDataFrame([(2.0,), (None,)], "x double")
    assert [r.q for r in exact_quantiles(df, "x", [0.1, 0.5]).collect()] == [2.0, 2.0]
    assert exact_quantiles(df.where("x IS NULL"), "x", [0.5]).count() == 0


def test_column_stats_and_correlations(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(200, 2)), columns=["a", "b"])
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r for r in column_stats(df, ["a", "b"]).collect()}
    assert np.isclose(got["a"].median, pdf.a.median()) and np.isclose(got["b"]["std"], pdf.b.std(ddof=0))
    corr = {(r.col_a, r.col_b): r.corr for r in corr_matrix(df, ["a", "b"]).collect()}
    assert np.isclose(corr["a", "b"], pdf.a.corr(pdf.b)) and np.isclose(corr["b", "b"], 1.0) and len(corr) == 4


def test_dispersion_over_all_cells(spark):
    m = np.random.default_rng(7).normal(size=(50, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in m], "f array<double>")
    r = dispersion(df, "f").first()
    want = [m.var(), m.std(), m.max() - m.min(), np.percentile(m, 75) - np.percentile(m, 25)]
    close([r.variance, r["std"], r["range"], r.iqr], want)


def test_context_rows_around_a_gap(spark):
    rows = [(i, t) for i, t in enumerate(minutes(*range(10), *range(40, 50)))]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    out = context_rows(df, SeriesSpec(tiebreak=("id",)), 25, 3)
    assert series(out, ["slot"], "id") == [7, 8, 9, 10, 11, 12]


def test_scalers(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 4.0], "b": [5.0, 5.0, 5.0]})
    df = spark.createDataFrame(pdf)
    s = Scaler.fit(df, ["a", "b"])
    out = s.transform(df).toPandas()
    np.testing.assert_allclose(out.a, (pdf.a - pdf.a.mean()) / pdf.a.std(ddof=0))
    assert (out.b == 0).all()
    np.testing.assert_allclose(s.inverse(s.transform(df)).toPandas(), pdf)
    wide = Scaler.fit(df, ["a", "b"], "minmax", matrix_wide=True).transform(df).toPandas()
    np.testing.assert_allclose(wide.a, (pdf.a - 1) / 4)
    given = df.select(minmax_given(F.col("a"), min_val=F.lit(1.0), max_val=F.lit(1.0)).alias("m"),
                      standard_given(F.col("a"), mean=F.lit(1.0), std=F.lit(0.0)).alias("s")).collect()
    assert all(r.m is None and r.s is None for r in given)


def test_fold_stats_leave_the_fold_out(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"f": rng.integers(0, 4, 200), "a": 1e6 + rng.normal(size=200)})
    got = fold_stats(spark.createDataFrame(pdf), "f", ["a"]).toPandas().set_index("f")
    for f in range(4):
        rest = pdf[pdf.f != f].a
        assert np.isclose(got["mean"][f], rest.mean()) and np.isclose(got["std"][f], rest.std(), rtol=1e-6)


def test_radix_selection_settles_every_bit(spark):
    """Values that differ in their last bits, cross powers of two and zero, and hold infinities, NaN and denormals."""
    rng = np.random.default_rng(11)
    near = [float(np.nextafter(1.0, 2.0) if i % 2 else np.nextafter(1.0, 0.0)) for i in range(5)] + [1.0 + i * 2 ** -52 for i in range(40)]
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 2.0 ** 60, 2.0 ** 60 + 256, -(2.0 ** 60)]
    cols = {"near": near * 3, "odd": odd * 12, "wide": (10.0 ** rng.uniform(-300, 300, 120) * rng.choice([-1, 1], 120)).tolist(),
            "tied": [1.5] * 100 + [2.5] * 32}
    n = max(map(len, cols.values()))
    rows = [tuple(v[i] if i < len(v) else None for v in cols.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.column, r.p): r.q for r in column_quantiles(df, list(cols), qs, salts=3).collect()}
    for c, v in cols.items():
        s = sorted(v)
        for q in qs:
            k = q * (len(s) - 1)
            lo, hi = s[int(k)], s[min(int(k) + 1, len(s) - 1)]
            want = lo if k == int(k) else lo + (hi - lo) * (k - int(k))
            assert got[c, q] == want or abs(got[c, q] - want) <= 1e-12 * abs(want) or (np.isnan(want) and np.isnan(got[c, q])), (c, q, got[c, q], want)


def test_nan_ranks_last_and_sortable_bits_round_trip(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, float("nan"), -2.0, None, 0.0)], "x double")
    assert [r.q for r in column_quantiles(df, ["x"], [0.0, 1 / 3, 2 / 3]).orderBy("p").collect()] == [-2.0, 0.0, 1.0]
    bits = df.where("x IS NOT NULL AND NOT isnan(x)").withColumn("s", sortable(F.col("x"))).orderBy("x").collect()
    assert [r.s for r in bits] == sorted(r.s for r in bits)


def test_quantiles_scan_the_rows_twice(spark, tmp_path):
    spark.range(2000).select((F.col("id") * 1.7 % 13).alias("a"), F.sqrt("id").alias("b")).write.parquet(str(tmp_path / "t"))
    out = column_quantiles(spark.read.parquet(str(tmp_path / "t")), ["a", "b"], [0.5])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 2
