"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sensorweave.catalog.base import QUERIES, SENS, lineitem
from sensorweave.catalog.features import XS, days_of
from sensorweave.functions.scaling import Scaler
from sensorweave.operators.assign import assign, quantization_error
from sensorweave.operators.codebook import random_codebook
from sensorweave.operators.dayshape import lag_corr
from sensorweave.operators.fuzzy import init_from_data, predict
from sensorweave.plans.som_training import TrainingParams, fit
from sensorweave.spec import configure

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def scaled_lines(spark, d):
    df = lineitem(spark, d).select(*COLS)
    return Scaler.fit(df, COLS).transform(df).select(F.array(*COLS).alias("features"))


def map_quality(spark, d):
    """Nearest neuron and quantization error, 4 columns, 12 x 12 map."""
    return quantization_error(assign(scaled_lines(spark, d), random_codebook(12, 12, 4)))


def map_epoch(spark, d):
    """One batch epoch of a 12 x 12 map on the same rows."""
    book, _ = fit(scaled_lines(spark, d), random_codebook(12, 12, 4), TrainingParams(epochs=1, kernel="exp"))
    return book.table(spark)


def lag_corr_90(spark, d):
    return lag_corr(days_of(spark, d), SENS, XS, "view", 90)


def fuzzy_scoring(spark, d):
    """Sixteen rules on four inputs, scored as one column expression."""
    df = lineitem(spark, d)
    model = init_from_data(df, COLS, 2, "bell")
    return predict(df, model).agg(F.avg("prediction"), F.count("prediction"))


BENCH = {
    "clean_series": QUERIES["w9_clean_series"],
    "interpolated_segments": QUERIES["w8_linear_interpolation"],
    "gap_segments": QUERIES["w2_gap_segments"],
    "time_difference": QUERIES["w1_time_difference"],
    "resample_grid": QUERIES["a4_resample_per_key"],
    "supervised_set": QUERIES["w15_supervised_set"],
    "lag_correlation_90": lag_corr_90,
    "amplitude_spectrum": QUERIES["w21_amplitude_spectrum"],
    "column_stats": QUERIES["a12_column_stats"],
    "standard_scale": QUERIES["f6_standard_scale"],
    "map_quality": map_quality,
    "map_epoch": map_epoch,
    "qe_novelty": QUERIES["n19_qe_novelty_by_neuron"],
    "fuzzy_scoring": fuzzy_scoring,
    "least_squares_outputs": QUERIES["g13_sugeno_least_squares"],
    "leave_one_fold_out": QUERIES["g18_leave_one_fold_out"],
}


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    only = sys.argv[1:]

    def timed(fn) -> float:
        t0 = time.perf_counter()
        fn(spark, d).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t0, 3)

    def control() -> list[float]:
        """The same small query before and after all others: tells a slower session from a slower query."""
        timed(BENCH["gap_segments"])
        return [timed(BENCH["gap_segments"]) for _ in range(runs)]

    first = control()
    times, spread = {}, {}
    for name, fn in BENCH.items():
        if only and name not in only:
            continue
        timed(fn)  # warm up
        taken = [timed(fn) for _ in range(runs)]
        times[name], spread[name] = statistics.median(taken), [min(taken), max(taken)]
    print(json.dumps({"metric": "total_warm_median", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(d.rstrip("/")), "spread": spread,
                      "control": {"first": first, "last": control()}}))
    spark.stop()


if __name__ == "__main__":
    main()
