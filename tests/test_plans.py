"""What the physical plans must look like, with broadcasts switched off where size would hide a problem."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorweave import SeriesSpec
from sensorweave.catalog import ORACLES, QUERIES
from sensorweave.operators import codebook as C
from sensorweave.operators.assign import assign, assign_columns
from sensorweave.operators.fuzzy import predict, spaced_model
from sensorweave.operators.segments import (
    align_rate, attach_parts, grid_segments, interpolate, null_free_parts, segment_by_gap,
)
from sensorweave.sources.stage import stage
from tests.helpers import gridded, with_gaps

K = SeriesSpec(keys=("k",))


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"#\d+L?", "", text.split("== Initial Plan ==")[0])


@pytest.fixture
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in zip(names, old):
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_segmentation_never_sorts_rows_of_a_series(spark, no_broadcast):
    df = stage(gridded(spark, range(50)))
    text = plan(segment_by_gap(df, K, 600))
    # The only ordering by series is that of the cell table, behind a partial aggregate.
    assert "partial_min(_t)" in text
    big = text.split("SortMergeJoin")[1].split("Window")[0]
    assert "hashpartitioning(k, _cell" in big


def test_cleaning_steps_share_one_row_shuffle(spark, no_broadcast):
    grid = stage(gridded(spark, with_gaps(np.random.default_rng(0), 300)))
    parts = stage(null_free_parts(align_rate(grid, K, 2, ["x"]), K, "x", 3))
    best = stage(spark.createDataFrame([("a", 0, 0, 0)], "k string, phase long, _lo_chunk long, _hi_chunk long"))
    out = interpolate(attach_parts(align_rate(grid, K, 2, ["x"], best), K, parts), K.within("part_id"), ["x"], cluster=K.keys)
    out.collect()
    text = plan(out)
    carries_ts = [block for block in re.findall(r"Exchange hashpartitioning\([^)]*\).*\n(?:.*\n){1,12}?.*FileScan parquet \[[^\]]*\]", text)
                  if "ts" in block.rsplit("[", 1)[1]]
    assert len(carries_ts) == 1
    assert "hashpartitioning(k, chunk_id" in carries_ts[0]


def test_scan_reads_only_needed_columns_and_pushes_filters(spark):
    df = stage(gridded(spark, range(10)).withColumn("unused", F.lit(1.0)))
    text = plan(df.where("x > 3").groupBy("k").agg(F.sum("x")))
    assert "unused" not in text and "PushedFilters: [IsNotNull(x), GreaterThan(x,3.0)]" in text


def test_fuzzy_scoring_and_small_maps_stay_in_the_jvm(spark):
    df = stage(gridded(spark, range(10)).select("x", F.col("x").alias("y")))
    text = plan(predict(df, spaced_model({"x": (0, 9), "y": (0, 9)}, 4)))
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text
    text = plan(assign_columns(df, C.random_codebook(3, 3, 2), ["x", "y"]))
    assert "Python" not in text and "Exchange" not in text


def test_assignment_is_narrow(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "features array<double>")
    text = plan(assign(df, C.random_codebook(3, 3, 2)))
    assert "Exchange" not in text and "Join" not in text


def test_grid_aggregates_before_it_shuffles(spark, no_broadcast):
    df = stage(gridded(spark, range(50)).drop("slot"))
    text = plan(grid_segments(df, K, 60, 600, {"x": F.avg("x")}))
    assert "partial_avg(x)" in text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 180 and len(ORACLES) > 160


def test_a_dominant_series_is_spread_over_tasks(spark, small_chunks, no_broadcast):
    """One series with most of the rows: its rows leave the chunk shuffle in many partitions."""
    values = with_gaps(np.random.default_rng(1), 800)
    df = gridded(spark, values).unionByName(gridded(spark, [1.0] * 30, key=("b",)))
    out = interpolate(df, K, ["x"]).withColumn("p", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.where("k = 'a'").groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 500
