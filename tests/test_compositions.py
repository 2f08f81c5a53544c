import datetime as dt

import numpy as np
import pandas as pd
import pytest

from sensorweave import SeriesSpec
from sensorweave.plans.dayreport import day_report
from sensorweave.plans.novelty_run import NoveltyRun, working_hours_novelty
from sensorweave.plans.som_training import TrainingParams
from sensorweave.plans.supervised import SupervisedParams, supervised
from tests.helpers import T0

K = SeriesSpec(keys=("building",))


@pytest.fixture(scope="module")
def building(spark):
    """Two weeks of two buildings on a 10-minute grid, with a strange Wednesday afternoon in one."""
    rng = np.random.default_rng(0)
    rows = []
    for name in ("a", "b"):
        for i in range(14 * 144):
            ts = T0 + dt.timedelta(minutes=10 * i)
            phase = 2 * np.pi * (i % 144) / 144
            x, y = np.sin(phase), np.cos(phase)
            if name == "a" and ts.date() == dt.date(2024, 1, 10) and 12 <= ts.hour < 14:
                x, y = 4.0, -4.0
            rows.append((name, i, ts, float(x + 0.02 * rng.normal()), float(y + 0.02 * rng.normal())))
    return spark.createDataFrame(rows, "building string, slot long, ts timestamp_ntz, x double, y double").cache()


def test_strange_rows_stand_out(building):
    run = NoveltyRun(rows=6, cols=6, train_percent=80, training=TrainingParams(epochs=6, kernel="exp", sigma=1.0))
    out = working_hours_novelty(building, K, ["x", "y"], ["slot"], run).toPandas()
    strange = (out.building == "a") & (out.ts.dt.date == dt.date(2024, 1, 10)) & out.ts.dt.hour.isin([12, 13])
    assert 0 < strange.sum() < 12
    assert out.ts.dt.dayofweek.max() < 5 and set(out.columns) == {"building", "slot", "ts", "nd_worst", "nd_by_bmu", "knn"}
    assert out.knn[strange].min() > out.knn[~strange].quantile(0.99)
    assert out.nd_worst[~strange].mean() > 0.5
    assert out.nd_worst.between(0, 1).all() and (out.nd_by_bmu <= out.nd_worst + 1e-12).all()


def test_day_report_averages_its_daily_tables(building):
    report = day_report(building, K, ["x"], "y", start="05:00", end="17:30", max_shift=20, rate_hz=1 / 600, max_hz=3e-4,
                        circular=True, removed_days=[dt.date(2024, 1, 10)])
    assert report["profile"].select("building", "day_id").distinct().count() == 18
    corr = report["corr"].toPandas()
    want = corr.groupby(["building", "shift"])["corr"].mean()
    np.testing.assert_allclose(report["mean_corr"].toPandas().set_index(["building", "shift"])["corr"].sort_index(), want.sort_index())
    freq = report["freq"].toPandas()
    want = freq.groupby(["building", "signal", "k"])["mag"].mean().sort_index()
    got = report["mean_freq"].toPandas().set_index(["building", "signal", "k"])["mag"].sort_index()
    np.testing.assert_allclose(got, want)


def test_supervised_rows_follow_the_published_order(building):
    params = SupervisedParams(target="y", smoothed=["x", "y"], difference=("x", "y"), kernel=5, ahead=6, start="05:00",
                              end="17:30", removed_days=[dt.date(2024, 1, 10)])
    cols = ["x", "y", "diff", "hours_sin", "hours_cos", "target_ahead"]
    got = supervised(building, K, params, cols).toPandas().sort_values(["building", "ts"])
    for name, pdf in building.toPandas().groupby("building"):
        pdf = pdf.sort_values("ts").set_index("ts")
        for c in ("x", "y"):
            pdf[c] = np.convolve(np.pad(pdf[c], (2, 2), "edge"), np.ones(5) / 5, "valid")
        pdf["target_ahead"] = pdf.y.shift(-6)
        pdf["diff"] = pdf.x - pdf.y
        pdf = pdf.iloc[:-6].between_time("05:00", "17:30")
        pdf = pdf[(pdf.index.dayofweek < 5) & (pdf.index.date != dt.date(2024, 1, 10))]
        sizes = pdf.groupby(pdf.index.date).size()
        pdf = pdf[[sizes[d] == sizes.max() for d in pdf.index.date]]
        mine = got[got.building == name]
        assert list(mine.ts) == list(pdf.index)
        assert list(mine.day_id) == list(pd.factorize(pdf.index.date)[0])
        np.testing.assert_allclose(mine[["x", "y", "diff", "target_ahead"]], pdf[["x", "y", "diff", "target_ahead"]])
        np.testing.assert_allclose(mine.hours_sin, np.sin(2 * np.pi * pdf.index.hour / 24), atol=1e-12)


def test_no_rows_keep_the_schema(building):
    params = SupervisedParams(target="y", smoothed=["x"], ahead=6)
    out = supervised(building.where("false"), K, params, ["x", "target_ahead"])
    assert out.columns == ["building", "day_id", "slot", "ts", "x", "target_ahead"] and out.count() == 0
