"""Nearest neurons by kept bounds: the same as brute force, with fewer distances."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorweave.operators import assign as A
from sensorweave.operators import bounds as B
from sensorweave.operators import codebook as C
from sensorweave.plans.som_training import TrainingParams, fit, fit_bounded
from tests.helpers import close


def clouds(n=3000, dim=4, seed=3):
    rng = np.random.default_rng(seed)
    return rng.uniform(-1, 1, (20, dim))[rng.integers(0, 20, n)] + 0.05 * rng.normal(size=(n, dim))


@given(st.integers(0, 10 ** 6), st.integers(1, 7), st.integers(1, 6), st.integers(1, 3), st.booleans())
@settings(max_examples=60, deadline=None)
def test_moving_map_finds_what_brute_force_finds(seed, rows, cols, side, grid):
    rng = np.random.default_rng(seed)
    book = C.Codebook(rng.integers(-2, 3, (rows * cols, 2)).astype(float) if grid else rng.normal(size=(rows * cols, 2)), rows, cols)
    x = rng.integers(-3, 4, (80, 2)).astype(float) if grid else rng.normal(size=(80, 2))
    groups = B.tiles(book, side)
    assert sorted(np.concatenate(groups).tolist()) == list(range(rows * cols))
    hit = low = moved = None
    w = book.weights
    for step in range(6):
        kept = B.search(x, w, groups, hit, low, moved)
        d = A.distances(x, w, "sqeuclidean")
        assert kept[0].tolist() == d.argmin(axis=1).tolist()
        np.testing.assert_array_equal(kept[1], np.sqrt(d.min(axis=1)))
        exact = np.sqrt(d)
        for i, g in enumerate(groups):
            others = np.where(g[None, :] == kept[0][:, None], np.inf, exact[:, g]).min(axis=1)
            assert (kept[2][:, i] <= others).all()
        hit, low = kept[0], kept[2]
        w_next = w + (rng.integers(-1, 2, w.shape) if grid else rng.normal(size=w.shape) * 0.5 ** step)
        moved = np.linalg.norm(w_next - w, axis=1)
        w = w_next


def test_training_equals_the_plain_form_with_fewer_distances(spark):
    x = clouds()
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "features array<double>")
    start = C.pca_codebook(df.where("features is not null"), "features", 4, 10, 10)
    p = TrainingParams(epochs=8, kernel="exp", schedule="linear", sigma=1.0, lr=0.5)
    plain, errors = fit(df, start, p)
    book, history = fit_bounded(df, start, p)
    np.testing.assert_allclose(book.weights, plain.weights, rtol=0, atol=1e-9)
    close([h["error"] for h in history], errors)
    assert all(h["every"] == len(x) * 100 for h in history)
    assert all(h["measured"] < 0.4 * h["every"] for h in history[2:])
    assert history[-1]["measured"] < 0.2 * history[-1]["every"]


@pytest.mark.parametrize("rewrite", [0.0, 1.1])
def test_rewriting_changes_the_work_alone(spark, rewrite):
    df = spark.createDataFrame([(v.tolist(),) for v in clouds(400, 2)], "features array<double>")
    start = C.Codebook(np.random.default_rng(2).uniform(-1, 1, (12, 2)), 3, 4)
    p = TrainingParams(epochs=4, kernel="gaussian", schedule="asymptotic", sigma=1.0, lr=0.4)
    np.testing.assert_allclose(fit_bounded(df, start, p, rewrite_above=rewrite)[0].weights, fit(df, start, p)[0].weights, atol=1e-9)


def test_no_rows(spark):
    with pytest.raises(ValueError):
        fit_bounded(spark.createDataFrame([(None,)], "features array<double>"), C.Codebook(np.zeros((4, 2)), 2, 2))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_summary_equals_the_table(spark, metric):
    x = clouds(300, 3)
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "features array<double>")
    book = C.Codebook(x[:6], 2, 3)
    want = A.distance_table(df.where("features is not null"), book, metric=metric).groupBy("bmu").agg(
        F.count("dist").alias("n"), F.min("dist"), F.avg("dist"), F.max("dist")).orderBy("bmu").collect()
    got = B.distance_summary(df, book, metric=metric).orderBy("bmu").collect()
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want] and len(got) == 6
    for i in (2, 3, 4):
        close([r[i] for r in got], [r[i] for r in want])
    assert B.distance_summary(df.where("features is null"), book, metric=metric).collect() == []
