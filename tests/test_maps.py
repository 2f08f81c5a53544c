import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorweave.operators import assign as A
from sensorweave.operators import codebook as C
from sensorweave.operators import novelty as V
from sensorweave.functions.scaling import hash_share
from sensorweave.plans.som_training import TrainingParams, fit, fit_many, sweep, sweep_summary, sweep_table, update_one
from tests.helpers import T0, close, series

RNG = np.random.default_rng(0)
X = RNG.normal(size=(300, 3))
BOOK = C.Codebook(RNG.normal(size=(12, 3)), 3, 4)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, x.tolist(), int(i % 3)) for i, x in enumerate(X)],
                                 "id long, features array<double>, label int").cache()


def brute(x, w):
    return np.linalg.norm(x[:, None] - w[None], axis=2)


def test_tie_goes_to_the_lowest_neuron(spark):
    book = C.Codebook.from_rows([[0, 0], [2, 0]], 1, 2)
    df = spark.createDataFrame([([1.0, 0.0],)], "features array<double>")
    assert A.assign(df, book).first().bmu == 0
    assert A.assign_columns(df.select(F.col("features")[0].alias("a"), F.col("features")[1].alias("b")), book, ["a", "b"]).first().bmu == 0


def test_assignment_matches_brute_force(rows):
    d = brute(X, BOOK.weights)
    out = A.assign(rows, BOOK)
    assert series(out, ["id"], "bmu") == d.argmin(1).tolist()
    close(series(out, ["id"], "dmin"), d.min(1).tolist())
    assert series(out, ["id"], "row") == (d.argmin(1) // 4).tolist()
    three = A.assign(rows, BOOK, k=3)
    assert [r[:3] for r in series(three, ["id"], "bmus")] == np.argsort(d, axis=1, kind="stable")[:, :3].tolist()


def test_column_form_agrees_with_array_form(rows):
    cols = rows.select("id", *[F.col("features")[i].alias(f"c{i}") for i in range(3)])
    assert series(A.assign_columns(cols, BOOK, ["c0", "c1", "c2"]), ["id"], "bmu") == series(A.assign(rows, BOOK), ["id"], "bmu")


@pytest.mark.parametrize("k", [1, 2, 3])
def test_product_shortcut_keeps_ties_in_order(k):
    rng = np.random.default_rng(1)
    x, w = rng.integers(-2, 3, (500, 4)).astype(float), rng.integers(-2, 3, (60, 4)).astype(float)
    idx, dist = A.nearest(x, w, k)
    d = brute(x, w)
    # Integer coordinates make squared distances exact, so ties are real ties.
    want = np.argsort((d ** 2).round(), axis=1, kind="stable")[:, :k]
    assert (idx == want).all()
    np.testing.assert_allclose(dist, np.take_along_axis(d, want, 1))


def test_null_features_stay_null(spark):
    df = spark.createDataFrame([(0, None), (1, [0.0, 0.0, 0.0])], "id long, features array<double>")
    out = A.assign(df, BOOK).orderBy("id").collect()
    assert out[0].bmu is None and out[0].dmin is None and out[1].bmu is not None
    assert A.assign(df, BOOK, k=2).orderBy("id").first().bmus is None
    assert A.hit_map(A.assign(df, BOOK), BOOK.table(spark)).agg(F.sum("hits")).first()[0] == 1


def test_map_quality(rows, spark):
    d = brute(X, BOOK.weights)
    q = A.quantization_error(A.assign(rows, BOOK)).first()
    close([q.quantization_error, q.inertia], [d.min(1).mean(), (d.min(1) ** 2).sum()])
    two = np.argsort(d, axis=1, kind="stable")[:, :2]
    far = [max(abs(a // 4 - b // 4), abs(a % 4 - b % 4)) > 1 for a, b in two]
    te = A.topographic_error(A.assign(rows, BOOK, k=2), 4, 12).first()[0]
    assert np.isclose(te, np.mean(far))
    assert A.topographic_error(A.assign(rows, C.Codebook(BOOK.weights[:1], 1, 1), k=2), 1, 1).first()[0] is None


def test_hit_map_keeps_unhit_neurons(spark):
    book = C.Codebook.from_rows([[0.0], [10.0], [20.0]], 1, 3)
    df = spark.createDataFrame([([0.1],), ([-1.0],), ([9.0],)], "features array<double>")
    hits = A.hit_map(A.assign(df, book), book.table(spark))
    assert series(hits, ["bmu"], "hits") == [2, 1, 0]
    assert np.isclose(A.unused_percent(hits).first()[0], 100 / 3)
    maps = A.distance_maps(A.assign(df, book), book.table(spark))
    close(series(maps, ["bmu"], "dmax"), [1.0, 1.0, None])


def test_label_maps(spark):
    book = C.Codebook.from_rows([[0.0], [10.0], [20.0]], 1, 3)
    df = spark.createDataFrame([(0, [0.0], 1), (1, [0.0], 0), (2, [10.0], 1), (3, [0.0], 5), (4, [0.0], 5)], "id long, features array<double>, y int")
    hits = A.assign(df, book)
    assert series(A.binary_label_map(hits.where("y < 5"), book.table(spark), "y"), ["bmu"], "neuron_label") == [0, 1, 2]
    assert series(A.majority_label_map(hits, book.table(spark), "y", "id"), ["bmu"], "neuron_label") == [5, 1, 2]
    tied = A.majority_label_map(hits.where("id < 2"), book.table(spark), "y", "id")
    assert series(tied, ["bmu"], "neuron_label") == [1, 2, 2]


def test_grid_side_rule(spark):
    r = A.grid_side(spark.range(2000)).first()
    assert (r.neurons, r.side) == (223, 15)


# --- kernels and schedules ------------------------------------------------------------------------------

def test_kernels_at_the_hit_and_beyond():
    book = C.Codebook(np.zeros((9, 1)), 3, 3)
    d = C.grid_distance(book)
    assert (C.neighbourhood(book, "ceil", 0.25) == (d <= 1)).all()
    np.testing.assert_allclose(C.neighbourhood(book, "half", 1.0), 0.5 ** d)
    np.testing.assert_allclose(C.neighbourhood(book, "mult", 2.0), 2 * d)
    assert (C.neighbourhood(book, "exp", 0.0) == np.eye(9)).all()
    assert C.neighbourhood(book, "bubble", 1.0).sum() == 9
    assert C.neighbourhood(book, "triangle", 2.0)[4, 4] == 4.0
    assert C.neighbourhood(book, "mexican_hat", 0.5)[0, 8] < 0
    assert (C.neighbourhood(book, "square", 1e-4) == np.eye(9)).all()
    square = C.neighbourhood(book, "square", 1.0, max_distance=1)
    assert square[4, 0] > 0 and square[4, 8] == 0  # the window is closed below, open above


def test_schedules():
    assert C.schedule("linear", 2.0, 1.0)(1, 4) == (1.5, 0.75)
    assert C.schedule("inv", 2.0, 1.0)(0, 4) == (2.0, 1.0)
    assert C.schedule("constant", 2.0, 0.3)(3, 4) == (2.0, 0.3)
    assert C.schedule("asymptotic", 2.0, 1.0)(2, 4) == (1.0, 0.5)
    with pytest.raises(ValueError):
        C.schedule("other")(0, 1)


# --- training ---------------------------------------------------------------------------------------------

def test_one_epoch_is_the_kernel_weighted_mean(rows):
    p = TrainingParams(epochs=1, kernel="exp", schedule="constant", sigma=0.7, lr=0.4)
    book, history = fit(rows, BOOK, p)
    d = brute(X, BOOK.weights)
    h = C.neighbourhood(BOOK, "exp", 0.7)[d.argmin(1)]
    mean = (h.T @ X) / h.sum(0)[:, None]
    np.testing.assert_allclose(book.weights, BOOK.weights + 0.4 * (mean - BOOK.weights))
    assert np.isclose(history[0], (d.min(1) ** 2).mean())


def test_error_falls_while_the_neighbourhood_shrinks(rows):
    _, history = fit(rows, BOOK, TrainingParams(epochs=8, kernel="exp", schedule="linear", sigma=1.0, lr=1.0))
    assert history[-1] < history[0]


def test_many_features_use_the_long_sum(spark):
    x = RNG.normal(size=(40, 140))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>")
    start = C.Codebook(x[:4].copy(), 2, 2)
    book, _ = fit(df, start, TrainingParams(epochs=1, kernel="exp", schedule="constant", sigma=0.5, lr=1.0))
    h = C.neighbourhood(start, "exp", 0.5)[brute(x, start.weights).argmin(1)]
    np.testing.assert_allclose(book.weights, (h.T @ x) / h.sum(0)[:, None])


def test_several_maps_in_one_pass_equal_single_fits(rows):
    starts = {3: C.random_codebook(2, 2, 3, seed=1), 7: C.random_codebook(3, 3, 3, seed=2)}
    p = TrainingParams(epochs=2, kernel="ceil")
    both, _ = fit_many(rows, starts, p)
    for c, start in starts.items():
        np.testing.assert_allclose(both[c].weights, fit(rows, start, p)[0].weights)
    assert sweep(rows, starts, p).count() == 2


def test_single_row_update():
    p = TrainingParams(kernel="half")
    out = update_one(BOOK, X[0], p, 1.0, 0.5)
    h = C.neighbourhood(BOOK, "half", 1.0)[brute(X[:1], BOOK.weights).argmin()]
    np.testing.assert_allclose(out.weights, BOOK.weights + 0.5 * h[:, None] * (X[0] - BOOK.weights))


def test_starts(rows, spark):
    a = C.sampled_codebook(rows, "features", ["id"], 2, 3, seed=1)
    b = C.sampled_codebook(rows.repartition(7), "features", ["id"], 2, 3, seed=1)
    assert (a.weights == b.weights).all()
    assert np.allclose(np.linalg.norm(C.random_codebook(2, 2, 3, "unit").weights, axis=1), 1)
    mean, cov, n = C.covariance(rows, "features", 3)
    np.testing.assert_allclose(mean, X.mean(0))
    np.testing.assert_allclose(cov, np.cov(X.T))
    axes, share = C.principal_axes(cov, 3)
    assert np.isclose(share.sum(), 1) and (axes[np.abs(axes).argmax(0), range(3)] > 0).all()
    corner = C.pca_codebook(rows, "features", 3, 3, 4).weights[0]
    np.testing.assert_allclose(corner, -axes[:, 0] - axes[:, 1])


def test_training_on_nothing_is_an_error(rows):
    with pytest.raises(ValueError):
        fit(rows.where("false"), BOOK)


# --- novelty ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("dmax,eq,score", [
    (3.0, 0.5, 1.0), (3.0, 1.0, 1.0), (3.0, 2.0, 0.5), (3.0, 3.0, 0.0), (3.0, 4.0, 0.0),
    (0.4, 0.5, 0.0), (None, 0.5, 1.0), (None, 2.0, 0.0)])
def test_score_table(spark, dmax, eq, score):
    df = spark.createDataFrame([(eq, 1.0, dmax)], "e double, m double, d double")
    assert df.select(V.qe_score(F.col("e"), F.col("m"), F.col("d")).alias("s")).first().s == score


def test_knn_counts_hits_on_the_scored_rows(rows):
    d = brute(X, BOOK.weights)
    hits = np.bincount(d.argmin(1), minlength=12)
    nodes = BOOK.weights[hits >= 20]
    want = np.sort(brute(X, nodes), axis=1)[:, :2].mean(1)
    close(series(V.knn_novelty(rows, BOOK, k=2, min_hits=20), ["id"], "knn"), want.tolist())
    with pytest.raises(ValueError):
        V.knn_novelty(rows, BOOK, min_hits=10_000)


def test_planted_outliers_score_zero(spark):
    rng = np.random.default_rng(2)
    train = np.vstack([rng.uniform(0, 1, (400, 3)), rng.uniform(2, 3, (400, 3))])
    test = np.vstack([rng.uniform(5, 6, (30, 3)), rng.uniform(0, 1, (100, 3))])

    def table(m):
        return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, features array<double>")

    book, _ = fit(table(train), C.random_codebook(4, 4, 3, seed=0), TrainingParams(epochs=6, kernel="exp", sigma=1.5))
    stats = V.training_stats(table(train), book)
    nd = np.array(series(V.qe_novelty(table(test), stats, book), ["id"], "nd"))
    assert (nd[:30] == 0).all() and nd[30:].mean() > 0.5
    detected = table(test).join(V.qe_novelty(table(test), stats, book).where("nd = 0").select("id"), "id")
    share = V.detection_share(detected, table(test[:30]), ["id", "features"]).first()[0]
    assert share > 0.9


def test_nearest_record_in_batches_with_ties(spark):
    import datetime as dt

    h = np.random.default_rng(3).integers(0, 4, (200, 2)).astype(float)
    q = np.random.default_rng(4).integers(0, 4, (23, 2)).astype(float)
    hist = spark.createDataFrame([(T0 + dt.timedelta(minutes=i), *map(float, r)) for i, r in enumerate(h)], "ts timestamp_ntz, a double, b double")
    hist = hist.unionByName(hist.limit(1).withColumn("a", F.lit(None).cast("double"))).repartition(5)
    ask = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "q int, a double, b double")
    want = [T0 + dt.timedelta(minutes=int(np.linalg.norm(h - r, axis=1).argmin())) for r in q]
    for batch in (4096, 5):
        got = V.nearest_record(hist, ask, ["a", "b"], "ts", "q", batch)
        assert series(got, ["q"], "match_ts") == want


def nearest_by_hand(h, q):
    d = np.sqrt(((q[:, None] - h[None]) ** 2).sum(axis=2))
    return d.argmin(axis=1), d.min(axis=1)


def history(spark, h):
    import datetime as dt

    return spark.createDataFrame([(T0 + dt.timedelta(minutes=i), *map(float, r)) for i, r in enumerate(h)],
                                 "ts timestamp_ntz, a double, b double, c double")


def test_nearest_record_prunes_most_cells(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.uniform(0, 1000, (40, 3))
    h = np.repeat(centres, 60, axis=0) + rng.normal(size=(2400, 3))
    q = centres[rng.integers(0, 40, 300)] + rng.normal(size=(300, 3))
    monkeypatch.setattr(V, "ROWS", 50)  # several blocks a cell
    index = V.pivot_index(history(spark, h).repartition(6), ["a", "b", "c"], "ts")
    assert len(index.pivots) == 49 and index.count.sum() == 2400
    asked = spark.createDataFrame([(i % 290, *map(float, r)) for i, r in enumerate(q)], "q int, a double, b double, c double")
    got = V.nearest_record(None, asked, ["a", "b", "c"], "ts", "q", 7, index=index)
    at, dist = nearest_by_hand(h, q)
    import datetime as dt

    want = sorted((i % 290, T0 + dt.timedelta(minutes=int(k)), round(float(d), 9)) for i, (k, d) in enumerate(zip(at, dist)))
    assert sorted((r.q, r.match_ts, round(r.dist, 9)) for r in got.collect()) == want
    own = A.nearest(q, index.pivots, 1)[0][:, 0]
    assert index.reachable(q, own, dist).sum() < 0.1 * len(q) * len(index.pivots)


def test_nearest_record_with_a_hot_row_and_odd_queries(spark):
    import datetime as dt

    h = np.vstack([np.ones((300, 3)), np.random.default_rng(1).normal(size=(100, 3))])
    hist = history(spark, h)
    asked = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (1, 1.0, None, 1.0), (None, 1.0, 1.0, 1.1)], "q int, a double, b double, c double")
    got = V.nearest_record(hist, asked, ["a", "b", "c"], "ts", "q").collect()
    assert sorted((str(r.q), r.match_ts, round(r.dist, 6)) for r in got) == [("1", T0, 0.0), ("None", T0, 0.1)]
    assert V.nearest_record(hist.limit(0), asked, ["a", "b", "c"], "ts", "q").count() == 0
    one = V.pivot_index(hist, ["a", "b", "c"], "ts", pivots=1)
    assert V.nearest_record(hist, asked, ["a", "b", "c"], "ts", "q", index=one).count() == 2
    days = V.day_context(hist, "ts", V.nearest_record(hist, asked, ["a", "b", "c"], "ts", "q"), "q")
    assert days.count() == 2 * 400 and {r.match_ts for r in days.collect()} == {T0} and T0.date() == (T0 + dt.timedelta(minutes=399)).date()


def test_ties_within_digits_go_to_the_earliest(spark):
    h = np.array([[1.0, 0, 0], [1.0 + 1e-12, 0, 0], [-1.0, 0, 0], [5.0, 0, 0]])
    asked = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "q int, a double, b double, c double")
    shifted = history(spark, h[[1, 0, 2, 3]])
    assert V.nearest_record(shifted, asked, ["a", "b", "c"], "ts", "q", digits=9).first().match_ts == T0
    assert V.nearest_record(shifted, asked, ["a", "b", "c"], "ts", "q").first().match_ts > T0


def test_training_stats_in_one_pass(spark, rows):
    both = {r.bmu: r for r in V.training_stats(rows, BOOK, "both").collect()}
    d = brute(X, BOOK.weights)
    own, low = d.argmin(axis=1), d.min(axis=1)
    for i in range(12):
        mine = low[own == i]
        assert np.isclose(both[i].mean_dist, low.mean()) and np.isclose(both[i].worst, low.max())
        assert both[i].dmax is None if not len(mine) else np.isclose(both[i].dmax, mine.max())


def test_shared_rows_treat_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (1, 2.0), (3, 4.0)], "a int, b double")
    b = spark.createDataFrame([(1, None), (3, 4.0), (3, 4.0)], "a int, b double")
    assert V.shared_rows(a, b, ["a", "b"]).count() == 2
    assert V.shared_rows(a, b, ["a", "b"], keep=False).count() == 1


def test_frequent_tuples_are_spread(spark):
    a = spark.createDataFrame([(1, None, i) for i in range(600)] + [(i, 1.0, i) for i in range(400)], "a int, b double, id int").repartition(4)
    b = spark.createDataFrame([(1, None)] * 300 + [(i, 1.0) for i in range(0, 900, 2)], "a int, b double")
    for keep in (True, False):
        got = V.shared_rows(a, b, ["a", "b"], keep, hot_share=0.1)
        want = sorted(r.id for r in a.collect() if ((r.b is None) or r.a % 2 == 0) == keep)
        assert sorted(r.id for r in got.collect()) == want and got.columns == a.columns
    assert V.shared_rows(a.limit(0), b, ["a", "b"]).count() == 0


def test_hexagonal_maps_measure_on_the_plane(spark):
    book = C.Codebook(RNG.normal(size=(12, 3)), 3, 4, "hexagonal")
    p = book.plane()
    shift = [0.5 if (3 - c) % 2 == 0 else 0.0 for _ in range(3) for c in range(4)]
    np.testing.assert_allclose(p[:, 0], np.arange(12) // 4 - shift)
    h = C.neighbourhood(book, "gaussian", 0.9)
    want = np.exp(-((p[:, None] - p[None]) ** 2).sum(axis=2) / (2 * 0.81))
    np.testing.assert_allclose(h, want)
    flat = C.Codebook(book.weights, 3, 4)
    assert (C.neighbourhood(book, "bubble", 2.0) == C.neighbourhood(flat, "bubble", 2.0)).all()
    assert not np.allclose(h, C.neighbourhood(flat, "gaussian", 0.9))
    df = spark.createDataFrame([(x.tolist(),) for x in X], "features array<double>")
    trained, errors = fit(df, book, TrainingParams(epochs=4, kernel="gaussian", sigma=0.8, lr=0.5))
    assert trained.topology == "hexagonal" and errors[-1] < errors[0]
    with pytest.raises(ValueError):
        C.Codebook(book.weights, 3, 4, "round")


def test_sweep_holds_nested_samples(spark):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, features array<double>")
    got = sweep_table(df, "features", ["id"], [0.3, 1.0], [0.5, 2.0], [2, 4], TrainingParams(epochs=2, kernel="exp", lr=0.5))
    rows = got.collect()
    assert [(r.disp, r.som_size) for r in rows] == [(d, g) for _ in range(2) for d in (0.5, 2.0) for g in (2, 4)]
    share = df.select("id", hash_share(["id"]).alias("h")).collect()
    small = X[[r.id for r in share if r.h < 0.3]]
    assert {r["size"] for r in rows} == {len(small), 300}
    for r in rows:
        x = (small if r["size"] < 300 else X) * r.disp
        close([r["std"], r.centroid_std], [x.std(), np.linalg.norm(x - x.mean(axis=0), axis=1).std()], 1e-9)
        assert 0 <= r.unused_pct < 100
    assert [r.n for r in sweep_summary(got).collect()] == [4, 4]


def test_u_matrix_is_scaled_to_one(spark):
    for topology in ("rectangular", "hexagonal"):
        for scaling in ("mean", "sum"):
            u = series(A.u_matrix(BOOK, spark, scaling, topology), ["bmu"], "u")
            assert len(u) == 12 and max(u) == 1.0 and min(u) > 0
