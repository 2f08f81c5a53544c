"""CSV and model files, written from the given tables and read back."""

from pyspark.sql import functions as F

from sensorweave.catalog.base import CB_SQL, R, code25, emb, events, query, rnd
from sensorweave.catalog.cleaning import _GAP_SQL, EV
from sensorweave.catalog.fuzzy import IN_SQL, SUGENO, _G, _GRID, _SUGENO_NUM, model, points, weights_sql
from sensorweave.catalog.maps import NEAR_SQL, _book_view
from sensorweave.operators.assign import assign
from sensorweave.operators.fuzzy import predict
from sensorweave.operators.segments import segment_by_gap
from sensorweave.sources import csv as C
from sensorweave.sources import models as M
from sensorweave.sources.stage import new_path

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING, value DOUBLE"
_EVENT_SQL = f"SELECT event_id, ts, event_type, {R('value')} AS value FROM events"


def _written(spark, d, header=True):
    path = new_path(spark, "csv")
    C.write_csv(events(spark, d).select("event_id", "ts", "event_type", "value"), path, header=header)
    return path


def _shown(df):
    return df.select("event_id", "ts", "event_type", rnd("value").alias("value"))


@query("s1_s6_csv_with_header", _EVENT_SQL)
def _(spark, d):
    return _shown(C.read_csv(spark, _written(spark, d), EVENT_SCHEMA))


@query("s2_csv_without_header", _EVENT_SQL)
def _(spark, d):
    schema = "a BIGINT, b TIMESTAMP_NTZ, c STRING, v DOUBLE"
    df = C.read_csv(spark, _written(spark, d, header=False), schema, header=False, names=["event_id", "ts", "event_type", "value"])
    return _shown(df)


@query("s3_s7_find_in_zone", _EVENT_SQL)
def _(spark, d):
    root = new_path(spark, "zones")
    C.write_csv(events(spark, d).select("event_id", "ts", "event_type", "value"), C.zone_path(root, "raw", "events"))
    return _shown(C.find_csv(spark, root, "*.csv", EVENT_SCHEMA))


@query("s5_s6_partitioned_segments", _GAP_SQL + "SELECT event_id, event_type, segment_id FROM s")
def _(spark, d):
    path = new_path(spark, "segments")
    df = segment_by_gap(events(spark, d), EV, 5400).select("event_id", "event_type", "segment_id")
    C.write_parquet(df, path, partition_by=["event_type"])
    return spark.read.schema("event_id BIGINT, event_type STRING, segment_id BIGINT").parquet(path)


@query("s8_codebook_round_trip", f"WITH {CB_SQL} SELECT bmu, {R('w[1]', 6)} AS w1, {R('w[32]', 6)} AS w32, {R('list_sum(w)')} AS total FROM cb")
def _(spark, d):
    path = new_path(spark, "codebook")
    M.write_codebook(code25(spark, d).table(spark), path)
    return _book_view(M.read_codebook(spark, path).table(spark))


@query("s9_model_round_trip", f"WITH {IN_SQL}, {weights_sql(_G, _GRID)} SELECT l_linenumber, {R(f'avg(({_SUGENO_NUM}) / den)')} AS prediction FROM ws GROUP BY 1")
def _(spark, d):
    path = new_path(spark, "model")
    M.write_fuzzy(spark, model(**SUGENO), path)
    out = predict(points(spark, d), M.read_fuzzy(spark, path))
    return out.groupBy("l_linenumber").agg(rnd(F.avg("prediction")).alias("prediction"))


@query("s10_matrix_files_by_key", f"WITH {NEAR_SQL} SELECT vec_id, label AS actual, bmu AS predicted FROM near")
def _(spark, d):
    x, y = new_path(spark, "matrix"), new_path(spark, "matrix")
    C.write_csv(emb(spark, d).select("vec_id", "label"), x, header=False)
    C.write_csv(assign(emb(spark, d), code25(spark, d)).select("vec_id", "bmu"), y, header=False)
    actual = C.read_csv(spark, x, "vec_id BIGINT, actual INT", header=False)
    predicted = C.read_csv(spark, y, "vec_id BIGINT, predicted INT", header=False)
    return C.attach_predictions(actual, predicted, ["vec_id"])
