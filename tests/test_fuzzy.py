import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorweave.functions import metrics as M
from sensorweave.functions.membership import evaluate, membership, partials
from sensorweave.operators import fuzzy as Z
from sensorweave.functions.scaling import leave_one_out_stats
from sensorweave.operators import triangular
from sensorweave.plans import fuzzy_training as T
from tests.helpers import close, series

RNG = np.random.default_rng(0)
X = RNG.normal(size=(240, 2))
Y = np.sin(X[:, 0]) + 0.5 * X[:, 1] + 0.05 * RNG.normal(size=240)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, *map(float, x), float(y), int(i % 5)) for i, (x, y) in enumerate(zip(X, Y))],
                                 "id long, a double, b double, y double, f int").cache()


def random_model(kind, rules, output, seed=0):
    rng = np.random.default_rng(seed)
    shape = {"gauss": 2, "gauss_plain": 2, "bell": 3, "sigmoid": 2}[kind]
    sets = tuple(rng.uniform(0.7, 1.3, (3, shape)) for _ in range(2))
    picked = Z.paired_rules(3, 2) if rules == "paired" else Z.grid_rules([3, 3])
    coef, bias = Z.start_coef(output, len(picked), 2)
    return Z.FuzzyModel(("a", "b"), kind, sets, picked, output, rng.normal(size=coef.shape),
                        None if bias is None else rng.normal(size=bias.shape))


@pytest.mark.parametrize("kind", ["gauss", "gauss_plain", "bell", "sigmoid"])
@pytest.mark.parametrize("rules", ["paired", "grid"])
@pytest.mark.parametrize("output", ["proportional", "linear", "sugeno"])
def test_column_scores_equal_the_matrix_form(rows, kind, rules, output):
    m = random_model(kind, rules, output)
    close(series(Z.predict(rows, m), ["id"], "prediction"), T.forward(X, m)[0].tolist(), 1e-8)


@pytest.mark.parametrize("kind", ["gauss", "gauss_plain", "bell", "sigmoid"])
def test_partials_match_finite_differences(kind):
    p = random_model(kind, "paired", "proportional").sets[0]
    x = X[:20, 0]
    got = partials(x, kind, p, evaluate(x, kind, p))
    for j in range(p.shape[1]):
        step = np.zeros_like(p)
        step[:, j] = 1e-6
        want = (evaluate(x, kind, p + step) - evaluate(x, kind, p - step)) / 2e-6
        np.testing.assert_allclose(got[:, :, j], want, atol=1e-6)


@pytest.mark.parametrize("loss", ["mse", "sse", "huber"])
@pytest.mark.parametrize("output", ["proportional", "linear", "sugeno"])
@pytest.mark.parametrize("kind,rules", [("gauss", "paired"), ("bell", "grid"), ("sigmoid", "grid")])
def test_gradient_matches_finite_differences(loss, output, kind, rules):
    m = random_model(kind, rules, output, seed=3)
    theta = T.pack(m)
    grad = T.gradient(X[:30], Y[:30], m, loss)[:-2]

    def total(t):
        return T.loss_and_slope(T.forward(X[:30], T.unpack(m, t))[0] - Y[:30], loss)[0].sum()

    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        assert np.isclose(grad[i], (total(theta + step) - total(theta - step)) / 2e-6, rtol=1e-4, atol=1e-4)


def test_distributed_gradient_equals_the_local_one(rows):
    m = random_model("bell", "grid", "sugeno")
    value, grad, n = T.total_gradient(rows.repartition(5), m, "y", "mse")
    want = T.gradient(X, Y, m, "mse")
    assert n == 240 and np.isclose(value, want[-2] / 240)
    np.testing.assert_allclose(grad, want[:-2] / 240)


def test_membership_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 2.0, 3.0, None)], "x double")
    tri = df.select(membership(F.col("x"), "triangle", (0, 1, 3)).alias("m")).collect()
    close([r.m for r in tri], [0.0, 0.5, 1.0, 0.5, 0.0, None])
    box = df.select(membership(F.col("x"), "trapezoid", (0.5, 0.5, 2, 2)).alias("m")).collect()
    close([r.m for r in box], [0.0, 0.0, 1.0, 0.0, 0.0, None])
    with pytest.raises(ValueError):
        membership(F.col("x"), "triangle", (2, 1, 3))


def test_null_inputs_have_no_prediction(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert Z.predict(df, random_model("gauss", "grid", "sugeno")).first().prediction is None


def test_spaced_start(spark, rows):
    m = Z.init_from_data(rows, ["a", "b"], 5)
    np.testing.assert_allclose(m.sets[0][:, 0], np.linspace(X[:, 0].min(), X[:, 0].max(), 5))
    np.testing.assert_allclose(m.sets[1][:, 1], np.ptp(X[:, 1]) / 5)
    assert m.n_rules == 25


def test_least_squares_leaves_an_orthogonal_residual(rows):
    m = Z.init_from_data(rows, ["a", "b"], 2)
    fitted, sse = T.fit_consequents(rows, m, "y", ridge=1e-10)
    design = T._design(X, m)
    residual = Y - T.forward(X, fitted)[0]
    np.testing.assert_allclose(design.T @ residual, 0, atol=1e-5)
    assert np.isclose(sse, residual @ residual, rtol=1e-5)


def test_factors_merge_in_rounds(spark, rows, monkeypatch):
    monkeypatch.setattr(triangular, "FAN", 2)
    monkeypatch.setattr(triangular, "GATHER", 7)
    design = lambda x: {float(f): x[x[:, 2] == f] for f in np.unique(x[:, 2])}
    df = rows.select("a", "b", F.col("f").cast("double").alias("f")).repartition(9)
    one = triangular.factors(df, ["a", "b", "f"], 3, design)
    data = np.column_stack([X, np.arange(240) % 5])
    got = {r.fold: (np.array(r.r).reshape(3, 3), r.n) for r in one.collect()}
    for f, (r, n) in got.items():
        mine = data[data[:, 2] == f]
        assert n == len(mine) == 48
        np.testing.assert_allclose(r.T @ r, mine.T @ mine, atol=1e-9)
    for blocks in (None, 1, 5):
        rest = {r.fold: (np.array(r.r).reshape(3, 3), r.n) for r in triangular.all_but_one(one, 3, blocks).collect()}
        for f in range(5):
            others = data[data[:, 2] != f]
            assert rest[f][1] == 192
            np.testing.assert_allclose(rest[f][0].T @ rest[f][0], others.T @ others, atol=1e-9)


def test_ill_conditioned_rows_keep_their_digits(spark):
    """Columns that differ in the ninth digit: the normal equations are singular in doubles, the factor is not."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=400)
    design = np.column_stack([a, a + 1e-9 * rng.normal(size=400)])
    y = design @ [2.0, -1.0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([design, y])], "p double, q double, y double").repartition(4)
    r = np.array(triangular.factors(df, ["p", "q", "y"], 3, lambda x: {0.0: x}).first().r).reshape(3, 3)
    coef = triangular.solved(r)[0][:, 0]
    assert np.abs(coef - [2, -1]).max() < 1e-4
    ata = design.T @ design
    assert np.linalg.cond(ata) > 1e15  # no digits left there


def test_linear_outputs_and_several_targets(rows):
    m = random_model("gauss", "grid", "linear")
    both = T.fit_outputs(rows.withColumn("y2", 2 * F.col("y") - 1), m, ["y", "y2"], ridge=0.0)
    for target, want in (("y", Y), ("y2", 2 * Y - 1)):
        fitted, sse = both[target]
        a = T._design(X, m)
        best = np.linalg.lstsq(a, want, rcond=None)[0]
        assert np.isclose(sse, ((a @ best - want) ** 2).sum(), rtol=1e-8)
        assert np.isclose(((T.forward(X, fitted)[0] - want) ** 2).sum(), sse, rtol=1e-6)


def test_folds_on_one_scale_equal_one_fit_per_fold(rows):
    m = Z.spaced_model({"a": (-1.5, 1.5), "b": (-1.5, 1.5)}, 2)
    got = {r.f: r for r in T.evaluate_folds(rows, "f", m, "y", scaling="whole").collect()}
    ids = np.arange(240) % 5
    mx, sx, my, sy = X.mean(0), X.std(0, ddof=1), Y.mean(), Y.std(ddof=1)
    a, y = T._design((X - mx) / sx, m), (Y - my) / sy
    for f in range(5):
        rest = a[ids != f]
        coef = np.linalg.solve(rest.T @ rest + 1e-3 * np.eye(a.shape[1]), rest.T @ y[ids != f])
        e = np.abs(a[ids == f] @ coef * sy + my - Y[ids == f])
        close([got[f].error_sum, got[f].error_avg, got[f].error_max], [e.sum(), e.mean(), e.max()], 1e-7)
    with pytest.raises(ValueError):
        T.evaluate_folds(rows, "f", m, "y", scaling="none")


def test_statistics_outside_each_fold_from_one_scan(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 2)) + [1e6, 0]
    fold = rng.integers(0, 6, 300)
    data = [(None if f == 5 else int(f), float(r[0]), None if i % 7 == 0 else float(r[1])) for i, (f, r) in enumerate(zip(fold, x))]
    df = spark.createDataFrame(data, "f int, a double, b double")
    out = leave_one_out_stats(df, "f", ["a", "b"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 1
    for r in out.collect():
        at = 1 if r.column == "a" else 2
        mine = np.array([t[at] for t in data if (t[0] == r.f) == r.is_test and t[at] is not None])
        assert r.n == len(mine)
        close([r["mean"], r["std"]], [mine.mean(), mine.std(ddof=1)], 1e-7)


def test_gradient_training_lowers_the_loss(rows):
    m = Z.spaced_model({"a": (-2, 2), "b": (-2, 2)}, 3, "bell", "paired", "linear")
    for optimizer in (T.Adam(0.05), T.Momentum(0.01, 0.9)):
        _, history = T.fit_gradient(rows, m, "y", "huber", optimizer, steps=12)
        assert history[-1] < history[0]


def test_hybrid_training_lowers_the_error(rows):
    _, errors = T.fit_hybrid(rows, Z.init_from_data(rows, ["a", "b"], 2), "y", epochs=4)
    assert errors[-1] < errors[0]


def test_step_size_rule():
    assert np.isclose(T.adapt_rate(1.0, [4, 3, 2, 1]), 1.1)
    assert np.isclose(T.adapt_rate(1.0, [5, 4, 3, 4, 2]), 0.9)
    assert T.adapt_rate(1.0, [1, 2]) == 1.0


def test_candidate_costs(rows):
    models = [random_model("bell", "grid", "sugeno", s) for s in range(3)]
    got = series(T.score_candidates(rows.repartition(4), models, "y"), ["candidate"], "cost")
    close(got, [float(((T.forward(X, m)[0] - Y) ** 2).sum() / 2) for m in models])


@pytest.mark.parametrize("per_pass", [2, 64])
def test_folds_equal_one_fit_per_fold(rows, per_pass):
    m = Z.spaced_model({"a": (-1.5, 1.5), "b": (-1.5, 1.5)}, 2)
    got = {r.f: r for r in T.evaluate_folds(rows, "f", m, "y", folds_per_pass=per_pass).collect()}
    ids = np.arange(240) % 5
    for f in range(5):
        xt, yt = X[ids != f], Y[ids != f]
        mx, sx, my, sy = xt.mean(0), xt.std(0, ddof=1), yt.mean(), yt.std(ddof=1)
        a = T._design((xt - mx) / sx, m)
        coef = np.linalg.solve(a.T @ a + 1e-3 * np.eye(a.shape[1]), a.T @ ((yt - my) / sy))
        pred = T._design((X[ids == f] - mx) / sx, m) @ coef * sy + my
        e = np.abs(pred - Y[ids == f])
        close([got[f].error_sum, got[f].error_avg, got[f].error_max], [e.sum(), e.mean(), e.max()], 1e-7)


def test_folds_with_any_fit_agree_with_the_one_pass_form(rows):
    m = Z.spaced_model({"a": (-1.5, 1.5), "b": (-1.5, 1.5)}, 2)
    one = {r.f: r for r in T.evaluate_folds(rows, "f", m, "y").collect()}
    each = {r.f: r for r in T.evaluate_folds_with(rows, "f", m, "y", lambda df, m: T.fit_consequents(df, m, "y")[0]).collect()}
    for f in range(5):
        close(list(one[f][1:]), list(each[f][1:]), 1e-7)


def test_hybrid_returns_the_best_model_met(rows):
    start = Z.init_from_data(rows, ["a", "b"], 2)
    best, errors = T.fit_hybrid(rows, start, "y", epochs=6, rate=5.0)
    assert np.isclose(((T.forward(X, best)[0] - Y) ** 2).sum(), min(errors), rtol=1e-4)


def test_random_starts():
    for kind in ("gauss", "bell", "sigmoid"):
        for output in ("proportional", "linear", "sugeno"):
            m = Z.random_model(["a", "b"], 4, kind, output, seed=1)
            assert np.isfinite(T.forward(X, m)[0]).all() and len(T.pack(m)) > 0
    assert abs(Z.random_model(["a"], 50, how="normal").sets[0]).max() < 1
    with pytest.raises(ValueError):
        Z.random_model(["a"], 2, how="other")


# --- metrics -----------------------------------------------------------------------------------------------

def test_huber_golden(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (-2.0,)], "e double")
    assert [r[0] for r in df.select(M.huber_loss(F.col("e"))).collect()] == [0.125, 1.5, 1.5]


def test_binary_report_and_empty_ratios(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "y int, p int")
    r = M.binary_report(df, "y", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.accuracy, r.precision, r.recall, r.f1) == (1, 1, 1, 2, 0.6, 0.5, 0.5, 0.5)
    assert M.binary_report(df.where("p = 0"), "y", "p").first().precision == 0.0


@pytest.mark.parametrize("digits", [1, 6])
def test_average_precision(spark, digits):
    rng = np.random.default_rng(digits)
    s = rng.random(2000).round(digits)
    y = (rng.random(2000) < s).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    want, seen, hits = 0.0, 0, 0
    for v in sorted(set(s), reverse=True):
        p = y[s == v].sum()
        hits, seen = hits + p, seen + (s == v).sum()
        want += p / y.sum() * hits / seen
    assert np.isclose(M.average_precision(df, "y", "s").first()[0], want)


def test_error_summaries(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, 2.0)], "y double, p double")
    r = M.abs_error_summary(df, "y", "p").first()
    assert (r.error_sum, r.error_avg, r.error_max) == (3.0, 1.5, 2.0)
    q = M.regression_summary(df, "y", "p").first()
    close([q.mse, q.rmse, q.mape, q.half_sse], [2.5, 2.5 ** 0.5, 75.0, 2.5])
