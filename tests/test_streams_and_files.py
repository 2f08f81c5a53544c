import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorweave import SeriesSpec
from sensorweave.operators import codebook as C
from sensorweave.operators.assign import assign, quantization_error
from sensorweave.operators.novelty import qe_novelty, training_stats
from sensorweave.operators.segments import segments
from sensorweave.sources import csv as S
from sensorweave.sources import models as M
from sensorweave.sources.stage import stage
from sensorweave.streaming.scoring import run_to_table, stream_qe_novelty, stream_update_som
from sensorweave.streaming.open_state import Rule, bin_intervals, merged, run_bounded, segment_intervals
from sensorweave.streaming.series import stream_grid, stream_segments
from sensorweave.streaming.versions import MapVersions
from tests.helpers import T0, close, minutes, series
from tests.test_fuzzy import random_model

RAW = SeriesSpec(keys=("k",), tiebreak=("id",))


def raw(spark, times):
    return spark.createDataFrame([("a", i, t, float(i)) for i, t in enumerate(times)], "k string, id long, ts timestamp_ntz, x double")


def as_stream(spark, df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


# --- streams --------------------------------------------------------------------------------------------

def test_stream_segments_equal_batch_segments(spark, tmp_path):
    rng = np.random.default_rng(0)
    t = np.cumsum(rng.choice([1, 5, 30, 31, 90], 150))
    df = raw(spark, minutes(*t))
    src = str(tmp_path / "in")
    as_stream(spark, df.where("id < 70"), src)
    sdf = as_stream(spark, df.where("id >= 70"), src)
    out = run_to_table(stream_segments(sdf, RAW, 1800, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = [(r.start_ts, r.end_ts) for r in segments(df, RAW, 1800).orderBy("segment_id").collect()]
    got = [(r.start_ts, r.end_ts) for r in out.orderBy("start_ts").collect()]
    # The segments the watermark has not passed yet are still open.
    limit = df.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=40)
    assert got == [w for w in want if w[1] < limit] and len(got) > 10


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    as_stream(spark, raw(spark, minutes(0, 1, 600)), src)
    as_stream(spark, raw(spark, minutes(601)), src)
    sdf = as_stream(spark, raw(spark, minutes(2, 700, 1400)), src)
    out = run_to_table(stream_grid(sdf, RAW, 600, {"n": F.count("x")}, "5 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    first = [r.n for r in out.where(F.col("ts") == F.lit(T0)).collect()]
    assert first == [2]


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(80, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    book = C.random_codebook(3, 3, 3, "normal", 1)
    stats = stage(training_stats(df, book, "by_bmu"))
    sdf = as_stream(spark, df, str(tmp_path / "in"))
    out = run_to_table(stream_qe_novelty(sdf, book, stats).select("id", "nd"), str(tmp_path / "out"), str(tmp_path / "cp"))
    close(series(out, ["id"], "nd"), series(qe_novelty(df, stats, book), ["id"], "nd"))


def test_online_map_versions_and_replay(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(200, 2))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>")
    src, path = str(tmp_path / "in"), str(tmp_path / "map")
    for i in range(3):
        sdf = as_stream(spark, df, src)
    start = C.random_codebook(3, 3, 2, "uniform", 0)
    log = MapVersions(spark, path)
    run = lambda **o: stream_update_som(sdf, path, start, str(tmp_path / "cp"), sigma=0.5, lr=0.5, **o).awaitTermination(120)
    run()
    assert log.versions() == [-1, 0, 1, 2] and log.last() == 2
    errors = [quantization_error(assign(df, log.read(v))).first()[0] for v in log.versions()]
    assert errors == sorted(errors, reverse=True)
    np.testing.assert_allclose(log.read(-1).weights, start.weights)
    # batch 2 ran and was committed, but the stream did not hear of it
    after = log.read(2).weights
    (tmp_path / "cp" / "commits" / "2").unlink()
    (tmp_path / "cp" / "commits" / ".2.crc").unlink(missing_ok=True)
    run()
    assert log.last() == 2 and (log.read().weights == after).all()
    as_stream(spark, df, src)
    run(keep=2)
    assert log.versions() == [2, 3] and sum(n.startswith("version=") for n in os.listdir(path)) == 2


def test_half_written_versions_are_not_seen(spark, tmp_path):
    book = C.random_codebook(2, 2, 3, "normal", 1)
    log = MapVersions(spark, str(tmp_path / "m"))
    assert log.last() is None
    with pytest.raises(ValueError):
        log.read()
    assert log.commit(0, book) and not log.commit(0, book)
    M.write_codebook(C.random_codebook(2, 2, 3, "normal", 2).table(spark), str(tmp_path / "m" / "version=1-torn"))
    assert log.versions() == [0] and (log.read().weights == book.weights).all()
    log.compact(1)
    assert not (tmp_path / "m" / "version=1-torn").exists() and log.versions() == [0]
    with pytest.raises(ValueError):
        log.compact(0)


# --- state of our own -------------------------------------------------------------------------------------

KEYED = SeriesSpec(keys=("k", "room"))


def keyed(spark, rows):
    return spark.createDataFrame([(k, r, T0 + dt.timedelta(minutes=m) if m is not None else None, x) for k, r, m, x in rows],
                                 "k string, room long, ts timestamp_ntz, x double")


def runs_of(spark, batches, tmp_path, make):
    """One micro-batch per list of rows, in order, in one run."""
    src = str(tmp_path / "in")
    for rows in batches:
        sdf = as_stream(spark, keyed(spark, rows), src)
    return run_bounded(make(sdf), KEYED, str(tmp_path / "out"), str(tmp_path / "cp"))


def rows_of(df):
    return sorted((tuple(r) for r in df.select("k", "room", "start_ts", "end_ts", "n_rows").collect()), key=str)


def test_closed_and_open_segments_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for k, room in (("a", 1), ("a", None), (None, 1), ("b", 2)):
        t = np.cumsum(rng.choice([1.0, 5.0, 30.0, 31.0, 90.0], 120))
        rows += [(k, room, float(m), float(i) if i % 3 else None) for i, m in enumerate(t)]
    rows.sort(key=lambda r: r[2])
    at = [0, 100, 101, 250, 400, len(rows)]
    batches = [rows[a:b] for a, b in zip(at, at[1:])]
    for b in batches[1:4]:  # out of order within the hour
        rng.shuffle(b)
    got = runs_of(spark, batches, tmp_path, lambda s: segment_intervals(s, KEYED, 1800, "3 hours", ["x"]))
    want = segments(keyed(spark, rows), KEYED, 1800)
    whole = {(r.k, r.room, r.start_ts, r.end_ts) for r in want.collect()}
    assert {x[:4] for x in rows_of(got.all())} == whole and got.late.count() == 0
    assert got.closed.count() > 40 and got.open.count() >= 1  # the series that ends last is open
    total = got.all().agg(F.sum("n_rows"), F.sum("x_sum"), F.sum("x_known"), F.max("x_max")).first()
    known = [r[3] for r in rows if r[3] is not None]
    assert tuple(total) == (len(rows), sum(known), len(known), max(known))


def test_late_rows_go_aside_and_open_bins_close_later(spark, tmp_path):
    make = lambda s: bin_intervals(s, KEYED, 600, "5 minutes", ["x"])
    got = runs_of(spark, [[("a", 1, 0, 1.0), ("a", 1, 1, 2.0), ("a", 1, 600, 3.0)], [("a", 1, 601, 4.0)],
                          [("a", 1, 2, 9.0), ("a", 1, 598, 5.0), ("a", 1, None, 7.0)]], tmp_path, make)
    assert [(r.n_rows, r.x_sum) for r in got.closed.orderBy("start_ts").collect()] == [(2, 3.0)]
    assert [(r.start_ts, r.x_sum) for r in got.late.collect()] == [(T0 + dt.timedelta(minutes=2), 9.0)]
    assert [(r.n_rows, r.x_sum) for r in got.open.orderBy("start_ts").collect()] == [(1, 5.0), (2, 7.0)]
    # the same checkpoint again: what was open goes on
    more = runs_of(spark, [[("a", 1, 603, 1.0), ("b", 1, 900, 1.0)]], tmp_path, make)
    assert [(r.n_rows, r.x_sum) for r in more.closed.orderBy("start_ts").collect()] == [(2, 3.0), (1, 5.0), (3, 8.0)]
    assert [(r.k, r.n_rows) for r in more.open.collect()] == [("b", 1)]


def test_merging_intervals_is_associative():
    rng = np.random.default_rng(0)
    t = np.unique(rng.integers(0, 100_000, 400))
    whole = pd.DataFrame({"lo": t, "hi": t, "n": 1})
    for rule in (Rule(gap=300), Rule(step=700)):
        want = merged(whole, rule, []).values.tolist()
        for _ in range(5):
            part = rng.integers(0, 6, len(t))
            pieces = pd.concat([merged(whole[part == i], rule, []) for i in range(6)])
            assert merged(pieces, rule, []).values.tolist() == want


# --- files ----------------------------------------------------------------------------------------------

def test_csv_round_trip_with_and_without_header(spark, tmp_path):
    df = raw(spark, minutes(0, 0.25, 3))
    schema = "k STRING, id BIGINT, ts TIMESTAMP_NTZ, x DOUBLE"
    S.write_csv(df, str(tmp_path / "a"))
    assert sorted(S.read_csv(spark, str(tmp_path / "a"), schema).collect()) == sorted(df.collect())
    S.write_csv(df, str(tmp_path / "b"), header=False)
    back = S.read_csv(spark, str(tmp_path / "b"), schema, header=False, names=["k", "id", "ts", "v"])
    assert back.columns == ["k", "id", "ts", "v"] and back.count() == 3


def test_headerless_series_file(spark, tmp_path):
    path = tmp_path / "raw" / "deep" / "series.txt"
    path.parent.mkdir(parents=True)
    path.write_text("0,  2.500000\n1,  0.750000\n2,\n")
    df = S.find_csv(spark, str(tmp_path), "series.txt", "t BIGINT, x DOUBLE", header=False, ignoreLeadingWhiteSpace=True)
    assert [r[:] for r in df.orderBy("t").collect()] == [(0, 2.5), (1, 0.75), (2, None)]


def test_zones(tmp_path):
    assert S.zone_path("/data/", "raw", "x.csv") == "/data/raw/x.csv"
    with pytest.raises(ValueError):
        S.zone_path("/data", "other", "x.csv")


def test_time_column_detection(spark):
    rows = [("2022-05-25 10:00:00", "x", 1), ("2022-05-25 10:02:00.5", "2022-05-25 10:02:00", 2)]
    out = S.detect_time_column(spark.createDataFrame(rows, "when string, note string, n int"))
    assert out.columns == ["datetime", "note", "n"] and dict(out.dtypes)["datetime"] == "timestamp_ntz"
    blocked = spark.createDataFrame([*rows, (None, "y", 3)], "when string, note string, n int")
    assert S.detect_time_column(blocked).columns == ["when", "note", "n"]


def test_partitioned_parquet(spark, tmp_path):
    df = raw(spark, minutes(*range(20))).withColumn("segment_id", F.col("id") % 3)
    S.write_parquet(df, str(tmp_path / "p"), partition_by=["segment_id"])
    assert {d for d in os.listdir(tmp_path / "p") if d.startswith("segment_id")} == {f"segment_id={i}" for i in range(3)}
    assert spark.read.parquet(str(tmp_path / "p")).count() == 20


def test_models_survive_a_round_trip(spark, tmp_path):
    book = C.random_codebook(2, 3, 4, "normal", 1)
    M.write_codebook(book.table(spark), str(tmp_path / "c"))
    back = M.read_codebook(spark, str(tmp_path / "c"))
    assert (back.weights == book.weights).all() and (back.rows, back.cols) == (2, 3)
    for output in ("proportional", "linear", "sugeno"):
        m = random_model("bell", "grid", output)
        M.write_fuzzy(spark, m, str(tmp_path / output))
        got = M.read_fuzzy(spark, str(tmp_path / output))
        assert (got.coef == m.coef).all() and (got.rules == m.rules).all() and got.inputs == m.inputs
        assert all((a == b).all() for a, b in zip(got.sets, m.sets))


def test_predictions_join_by_key(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, y double")
    b = spark.createDataFrame([(2, 2.5), (1, 1.5)], "id int, p double")
    assert [r[:] for r in S.attach_predictions(a, b, ["id"]).orderBy("id").collect()] == [(1, 1.0, 1.5), (2, 2.0, 2.5)]
