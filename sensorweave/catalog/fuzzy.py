"""Neuro-fuzzy membership, scoring and training on lineitem and the daily order series."""

import numpy as np
from pyspark.sql import functions as F

from sensorweave.catalog.base import DAILY, LINE_KEY, R, SENS, daily, lineitem, query, rnd
from sensorweave.catalog.features import SUP_SQL, _EMBED_SQL, supervised_set
from sensorweave.functions.membership import membership
from sensorweave.functions.metrics import abs_error_summary, regression_summary, residuals
from sensorweave.operators.calendar import number_days
from sensorweave.operators.features import lag_embed
from sensorweave.operators.fuzzy import (
    FuzzyModel, grid_rules, init_from_data, mean_activation, membership_curves, normalised, paired_rules, predict,
    predict_many, random_model, spaced_model, strengths,
)
from sensorweave.sources.stage import stage
from sensorweave.plans.fuzzy_training import (
    Adam, Momentum, evaluate_folds, evaluate_folds_with, fit_consequents, fit_gradient, fit_hybrid, fit_outputs,
    score_candidates,
)

_KEY = ", ".join(LINE_KEY)
IN_SQL = f"inp AS (SELECT {_KEY}, l_extendedprice / 10000.0 AS y, (l_quantity - 25.5) / 14.5 AS x1, (l_discount - 0.05) / 0.03 AS x2 FROM lineitem)"


def points(spark, d):
    return lineitem(spark, d).select(
        *LINE_KEY, (F.col("l_extendedprice") / 10000.0).alias("y"),
        ((F.col("l_quantity") - 25.5) / 14.5).alias("x1"), ((F.col("l_discount") - 0.05) / 0.03).alias("x2"))


# Parameters of the fixed test models: two inputs with two sets each.
GAUSS = (np.array([[-0.8, 0.9], [0.7, 1.1]]), np.array([[-0.5, 1.0], [0.9, 0.8]]))
BELL = (np.array([[0.9, 1.2, -0.8], [1.1, 0.8, 0.7]]), np.array([[1.0, 1.0, -0.5], [0.8, 1.5, 0.9]]))


def gauss_sql(x: str, mu: float, s: float, half: str = "0.5") -> str:
    return f"exp(-{half} * pow({x} - ({mu}), 2) / pow({s} + 1e-12, 2))"


def bell_sql(x: str, a: float, b: float, c: float) -> str:
    return f"(1 / (1 + pow(abs(({x} - ({c})) / ({a} + 1e-12)), {2 * b})))"


_G = {(i, s): gauss_sql(f"x{i + 1}", *GAUSS[i][s]) for i in (0, 1) for s in (0, 1)}
_B = {(i, s): bell_sql(f"x{i + 1}", *BELL[i][s]) for i in (0, 1) for s in (0, 1)}
_PAIRED = [[0, 0], [1, 1]]
_GRID = [[0, 0], [0, 1], [1, 0], [1, 1]]


def weights_sql(sets: dict, rules, name: str = "ws") -> str:
    cols = ", ".join(f"{sets[0, r[0]]} * {sets[1, r[1]]} AS w{j}" for j, r in enumerate(rules))
    total = " + ".join(f"w{j}" for j in range(len(rules)))
    return (f"{name}0 AS (SELECT *, {cols} FROM inp), "
            f"{name} AS (SELECT *, least(greatest({total}, 1e-12), 1e12) AS den FROM {name}0)")


def model(sets=GAUSS, kind="gauss", rules="paired", output="proportional", coef=None, bias=None) -> FuzzyModel:
    picked = paired_rules(2, 2) if rules == "paired" else grid_rules([2, 2])
    return FuzzyModel(("x1", "x2"), kind, sets, picked, output, np.array(coef), None if bias is None else np.array(bias))


@query("g1_gauss_membership", f"WITH {IN_SQL} SELECT {_KEY}, {R(_G[0, 0], 5)} AS m, {R(gauss_sql('x1', -0.8, 0.9, '1.0'), 5)} AS plain FROM inp")
def _(spark, d):
    x = F.col("x1")
    return points(spark, d).select(*LINE_KEY, rnd(membership(x, "gauss", GAUSS[0][0]), 5).alias("m"),
                                   rnd(membership(x, "gauss_plain", GAUSS[0][0]), 5).alias("plain"))


@query("g2_bell_membership", f"WITH {IN_SQL} SELECT {_KEY}, {R(_B[0, 0], 5)} AS m FROM inp")
def _(spark, d):
    return points(spark, d).select(*LINE_KEY, rnd(membership(F.col("x1"), "bell", BELL[0][0]), 5).alias("m"))


@query("g3_triangle_trapezoid", f"""WITH {IN_SQL} SELECT {_KEY},
  {R("CASE WHEN x1 > -1.03 AND x1 <= 0.21 THEN (x1 + 1.03) / (0.21 + 1.03) WHEN x1 > 0.21 AND x1 <= 1.37 THEN (1.37 - x1) / (1.37 - 0.21) ELSE 0.0 END", 5)} AS tri,
  {R("greatest(least((x1 + 1.03) / (-0.41 + 1.03), (1.37 - x1) / (1.37 - 0.33), 1.0), 0.0)", 5)} AS trap
  FROM inp""")
def _(spark, d):
    x = F.col("x1")
    return points(spark, d).select(*LINE_KEY, rnd(membership(x, "triangle", (-1.03, 0.21, 1.37)), 5).alias("tri"),
                                   rnd(membership(x, "trapezoid", (-1.03, -0.41, 0.33, 1.37)), 5).alias("trap"))


@query("g4_sigmoid_membership", f"WITH {IN_SQL} SELECT {_KEY}, {R('1 / (1 + exp(-1.7 * (x1 - 0.3)))', 5)} AS m FROM inp")
def _(spark, d):
    return points(spark, d).select(*LINE_KEY, rnd(membership(F.col("x1"), "sigmoid", (1.7, 0.3)), 5).alias("m"))


def _w_cols(n):
    return ", ".join(f"{R(f'w{j}', 5)} AS w{j}" for j in range(n))


@query("g5_paired_strengths", f"WITH {IN_SQL}, {weights_sql(_G, _PAIRED)} SELECT {_KEY}, {_w_cols(2)} FROM ws")
def _(spark, d):
    out = strengths(points(spark, d), model(coef=[0.0, 0.0]), "w")
    return out.select(*LINE_KEY, *[rnd(F.col("w")[j], 5).alias(f"w{j}") for j in range(2)])


@query("g6_grid_strengths", f"WITH {IN_SQL}, {weights_sql(_B, _GRID)} SELECT {_KEY}, {_w_cols(4)} FROM ws")
def _(spark, d):
    out = strengths(points(spark, d), model(BELL, "bell", "grid", coef=[0.0] * 4), "w")
    return out.select(*LINE_KEY, *[rnd(F.col("w")[j], 5).alias(f"w{j}") for j in range(4)])


@query("g7_normalised_strengths", f"WITH {IN_SQL}, {weights_sql(_G, _GRID)} SELECT {_KEY}, "
       + ", ".join(f"{R(f'w{j} / den', 5)} AS a{j}" for j in range(4)) + " FROM ws")
def _(spark, d):
    out = normalised(points(spark, d), model(rules="grid", coef=[0.0] * 4), "a")
    return out.select(*LINE_KEY, *[rnd(F.col("a")[j], 5).alias(f"a{j}") for j in range(4)])


PROPORTIONAL = dict(sets=BELL, kind="bell", coef=[1.5, -0.7])
LINEAR = dict(output="linear", coef=[[0.4, -0.3], [1.1, 0.2]], bias=[0.05, -0.01])
SUGENO = dict(rules="grid", output="sugeno", coef=[[0.5, -0.2, 1.0], [0.1, 0.3, 2.0], [-0.4, 0.2, 3.0], [0.6, 0.6, 5.0]])
_SUGENO_NUM = " + ".join(f"w{j} * ({c[0]} * x1 + {c[1]} * x2 + {c[2]})" for j, c in enumerate(SUGENO["coef"]))


@query("g8_proportional_output", f"WITH {IN_SQL}, {weights_sql(_B, _PAIRED)} SELECT {_KEY}, {R('(w0 * 1.5 + w1 * -0.7) / den')} AS prediction FROM ws")
def _(spark, d):
    return predict(points(spark, d), model(**PROPORTIONAL)).select(*LINE_KEY, rnd("prediction").alias("prediction"))


@query("g9_linear_output", f"""WITH {IN_SQL}, {weights_sql(_G, _PAIRED)} SELECT {_KEY},
  {R('(w0 * 0.4 + w1 * 1.1 + 0.05 + w0 * -0.3 + w1 * 0.2 - 0.01) / den')} AS prediction FROM ws""")
def _(spark, d):
    return predict(points(spark, d), model(**LINEAR)).select(*LINE_KEY, rnd("prediction").alias("prediction"))


@query("g10_sugeno_output", f"WITH {IN_SQL}, {weights_sql(_G, _GRID)} SELECT {_KEY}, {R(f'({_SUGENO_NUM}) / den')} AS prediction FROM ws")
def _(spark, d):
    return predict(points(spark, d), model(**SUGENO)).select(*LINE_KEY, rnd("prediction").alias("prediction"))


@query("g10_two_outputs", f"""WITH {IN_SQL}, {weights_sql(_G, _GRID)} SELECT l_tax_group, {R(f'avg(({_SUGENO_NUM}) / den)')} AS first,
  {R('avg((w0 + 2 * w1 + 3 * w2 + 4 * w3) / den)')} AS second FROM (SELECT *, l_linenumber AS l_tax_group FROM ws) GROUP BY 1""")
def _(spark, d):
    second = model(rules="grid", coef=[1.0, 2.0, 3.0, 4.0])
    out = predict_many(points(spark, d), {"first": model(**SUGENO), "second": second})
    return out.groupBy(F.col("l_linenumber").alias("l_tax_group")).agg(
        rnd(F.avg("first")).alias("first"), rnd(F.avg("second")).alias("second"))


@query("g11_batch_scoring", f"WITH {IN_SQL}, {weights_sql(_G, _GRID)} SELECT {_KEY}, {R('y')} AS y, {R(f'({_SUGENO_NUM}) / den')} AS prediction FROM ws")
def _(spark, d):
    return predict(points(spark, d), model(**SUGENO)).select(*LINE_KEY, rnd("y").alias("y"), rnd("prediction").alias("prediction"))


@query("g15_spaced_start", """WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT s::INTEGER AS set, (round(lo + (hi - lo) * s / 4.0 + 1e-7, 4) + 0.0) AS mu, (round((hi - lo) / 5.0 + 1e-7, 4) + 0.0) AS sigma FROM b, range(5) t(s)""")
def _(spark, d):
    fitted = init_from_data(lineitem(spark, d), ["l_quantity"], 5)
    rows = [(i, float(mu), float(s)) for i, (mu, s) in enumerate(fitted.sets[0])]
    out = spark.createDataFrame(rows, "set int, mu double, sigma double")
    return out.select("set", rnd("mu").alias("mu"), rnd("sigma").alias("sigma"))


_CANDIDATES = [-1.0, -0.5, 0.0, 0.5, 1.0]


@query("g16_candidate_costs", f"WITH {IN_SQL}, {weights_sql(_B, _PAIRED)} " + " UNION ALL ".join(
    f"SELECT {i} AS candidate, {R(f'sum(pow((w0 * {1.5 + c} + w1 * {-0.7 + c}) / den - y, 2)) / 2', 2)} AS cost FROM ws"
    for i, c in enumerate(_CANDIDATES)))
def _(spark, d):
    models = [model(BELL, "bell", coef=[1.5 + c, -0.7 + c]) for c in _CANDIDATES]
    return score_candidates(points(spark, d), models, "y").select("candidate", rnd("cost", 2).alias("cost"))


@query("g17_rule_activation", f"WITH {IN_SQL}, {weights_sql(_G, _GRID)} " + " UNION ALL ".join(
    f"SELECT {j} AS rule, {R(f'avg(w{j} / den)', 6)} AS activation FROM ws" for j in range(4)))
def _(spark, d):
    out = mean_activation(points(spark, d), model(rules="grid", coef=[0.0] * 4))
    return out.select("rule", rnd("activation", 6).alias("activation"))


@query("g19_residuals", f"WITH {IN_SQL}, {weights_sql(_G, _GRID)} SELECT {_KEY}, {R(f'y - ({_SUGENO_NUM}) / den')} AS residual FROM ws")
def _(spark, d):
    out = residuals(predict(points(spark, d), model(**SUGENO)), "y", "prediction")
    return out.select(*LINE_KEY, rnd("residual").alias("residual"))


@query("g19_prediction_errors", f"""WITH {IN_SQL}, {weights_sql(_G, _GRID)}, e AS (SELECT l_linenumber, abs(y - ({_SUGENO_NUM}) / den) AS e FROM ws)
SELECT l_linenumber, {R('sum(e)', 3)} AS error_sum, {R('avg(e)')} AS error_avg, {R('max(e)')} AS error_max FROM e GROUP BY 1""")
def _(spark, d):
    out = abs_error_summary(predict(points(spark, d), model(**SUGENO)), "y", "prediction", ["l_linenumber"])
    return out.select("l_linenumber", rnd("error_sum", 3).alias("error_sum"), rnd("error_avg").alias("error_avg"),
                      rnd("error_max").alias("error_max"))


_CURVE_G = " UNION ALL ".join(
    f"SELECT '{n}' AS input, x, {s} AS set, exp(-0.5 * pow((x - (lo + (hi - lo) * {s} / 2.0)) / ((hi - lo) / 3.0 + 1e-12), 2)) AS grade FROM g WHERE name = '{n}'"
    for n in ("l_quantity", "l_tax") for s in range(3))


@query("g20_membership_curves", f"""WITH b AS (SELECT 'l_quantity' AS name, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem
  UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem),
g AS (SELECT name, lo, hi, lo + (hi - lo) * i / 20.0 AS x FROM b, range(21) t(i)), c AS ({_CURVE_G})
SELECT input, {R('x')} AS x, set, {R('grade', 5)} AS grade FROM c""")
def _(spark, d):
    df = lineitem(spark, d)
    fitted = init_from_data(df, ["l_quantity", "l_tax"], 3)
    bounds = {c: (float(s[0, 0]), float(s[-1, 0])) for c, s in zip(fitted.inputs, fitted.sets)}
    return membership_curves(spark, fitted, bounds, 21).select("input", rnd("x").alias("x"), "set", rnd("grade", 5).alias("grade"))


# --- training ------------------------------------------------------------------------------------------

def _steps(spark, history):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(history)], "step int, loss double")


def _fit_view(spark, d, fitted, df=None, target="y"):
    df = points(spark, d) if df is None else df
    return regression_summary(predict(df, fitted), target, "prediction")


@query("g12_adam_training")
def _(spark, d):
    df = stage(points(spark, d).select("x1", "x2", "y"))
    start = spaced_model({"x1": (-1.5, 1.5), "x2": (-1.5, 1.5)}, 3, "bell", "paired", "linear")
    fitted, history = fit_gradient(df, start, "y", "huber", Adam(0.05), steps=10)
    return _steps(spark, history)


@query("g12_momentum_training")
def _(spark, d):
    df = stage(points(spark, d).select("x1", "x2", "y"))
    start = spaced_model({"x1": (-1.5, 1.5), "x2": (-1.5, 1.5)}, 2, "gauss", "grid", "sugeno")
    fitted, _history = fit_gradient(df, start, "y", "mse", Momentum(0.05, 0.5), steps=8)
    return _fit_view(spark, d, fitted, df)


# One rule per region with constant outputs: the normal equations of two unknowns, in SQL.
_LSQ_SQL = f"""WITH {IN_SQL}, {weights_sql(_G, _PAIRED)}, a AS (SELECT w0 / den AS a, w1 / den AS b, y FROM ws),
s AS (SELECT sum(a * a) + 1e-3 AS aa, sum(a * b) AS ab, sum(b * b) + 1e-3 AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM a)
SELECT {R('(ay * bb - byy * ab) / (aa * bb - ab * ab)')} AS c0, {R('(byy * aa - ay * ab) / (aa * bb - ab * ab)')} AS c1 FROM s"""


@query("g13_least_squares_outputs", _LSQ_SQL)
def _(spark, d):
    fitted, _sse = fit_consequents(points(spark, d), model(coef=[0.0, 0.0]), "y")
    out = spark.createDataFrame([tuple(float(v) for v in fitted.coef)], "c0 double, c1 double")
    return out.select(rnd("c0").alias("c0"), rnd("c1").alias("c1"))


@query("g13_sugeno_least_squares")
def _(spark, d):
    start = spaced_model({"x1": (-1.7, 1.7), "x2": (-1.7, 1.7)}, 2)
    fitted, _sse = fit_consequents(points(spark, d), start, "y")
    return _fit_view(spark, d, fitted)


@query("g14_hybrid_training")
def _(spark, d):
    df = stage(points(spark, d).select("x1", "x2", "y"))
    start = spaced_model({"x1": (-1.7, 1.7), "x2": (-1.7, 1.7)}, 2)
    _fitted, errors = fit_hybrid(df, start, "y", epochs=3)
    return _steps(spark, errors)


def fold_sql(source: str, fold: str, x1: str, x2: str, y: str, others: bool = True) -> str:
    """Leave one fold out with two constant rules, as text: scale, normal equations of two unknowns, errors of the fold."""
    def g(x, mu, sigma):
        return f"exp(-0.5 * pow(({x} - ({mu})) / ({sigma} + 1e-12), 2))"

    w = [f"{g('z1', *GAUSS[0][j])} * {g('z2', *GAUSS[1][j])}" for j in (0, 1)]
    scale = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate((x1, x2, y)))
    fit = f"SELECT k, {scale} FROM src, ids WHERE {fold} <> k GROUP BY k" if others else f"SELECT k, t.* FROM ids, (SELECT {scale} FROM src) t"
    z = ", ".join(f"({c} - m{i}) / s{i} AS z{i + 1}" for i, c in enumerate((x1, x2, y)))
    return f"""src AS (SELECT * FROM {source}), ids AS (SELECT DISTINCT {fold} AS k FROM src), sc AS ({fit}),
zz AS (SELECT k, {fold} AS f, m2, s2, {y} AS y, {z} FROM src, sc WHERE {x1} IS NOT NULL AND {x2} IS NOT NULL AND {y} IS NOT NULL),
ww AS (SELECT *, {w[0]} AS w0, {w[1]} AS w1 FROM zz),
sh AS (SELECT *, w0 / least(greatest(w0 + w1, 1e-12), 1e12) AS a, w1 / least(greatest(w0 + w1, 1e-12), 1e12) AS b FROM ww),
ne AS (SELECT k, sum(a * a) + 1e-3 AS aa, sum(a * b) AS ab, sum(b * b) + 1e-3 AS bb, sum(a * z3) AS ay, sum(b * z3) AS byy FROM sh WHERE f <> k GROUP BY k),
co AS (SELECT k, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS c0, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS c1 FROM ne),
er AS (SELECT f, abs((c0 * a + c1 * b) * s2 + m2 - y) AS e FROM sh JOIN co USING (k) WHERE f = k)
SELECT f::INTEGER AS {{name}}, {R('sum(e)', 2)} AS error_sum, {R('avg(e)')} AS error_avg, {R('max(e)')} AS error_max, count(*) AS n_rows FROM er GROUP BY f"""


def _fold_view(out, name):
    return out.select(name, rnd("error_sum", 2).alias("error_sum"), rnd("error_avg").alias("error_avg"),
                      rnd("error_max").alias("error_max"), "n_rows")


def _sevenths(spark, d):
    return points(spark, d).withColumn("fold", (F.col("l_orderkey") % 7).cast("int"))


_SEVENTHS = "(SELECT *, (l_orderkey % 7)::INTEGER AS fold FROM inp)"


@query("g18_leave_one_fold_out", f"WITH {IN_SQL}, " + fold_sql(_SEVENTHS, "fold", "x1", "x2", "y").format(name="fold"))
def _(spark, d):
    return _fold_view(evaluate_folds(_sevenths(spark, d), "fold", model(coef=[0.0, 0.0]), "y"), "fold")


# One scale for all folds: the factors of all but one come from merges.
@query("g18_merged_folds", f"WITH {IN_SQL}, " + fold_sql(_SEVENTHS, "fold", "x1", "x2", "y", others=False).format(name="fold"))
def _(spark, d):
    return _fold_view(evaluate_folds(_sevenths(spark, d), "fold", model(coef=[0.0, 0.0]), "y", scaling="whole"), "fold")


@query("g18_sugeno_folds")
def _(spark, d):
    return evaluate_folds(_sevenths(spark, d), "fold", spaced_model({"x1": (-1.5, 1.5), "x2": (-1.5, 1.5)}, 2), "y")


@query("g18_hybrid_folds")
def _(spark, d):
    df = points(spark, d).withColumn("fold", (F.col("l_orderkey") % 3).cast("int"))
    start = spaced_model({"x1": (-1.5, 1.5), "x2": (-1.5, 1.5)}, 2)
    return evaluate_folds_with(df, "fold", start, "y", lambda rows, m: fit_hybrid(rows, m, "y", epochs=1)[0])


@query("g12_random_start_training")
def _(spark, d):
    df = stage(points(spark, d).select("x1", "x2", "y"))
    _fitted, history = fit_gradient(df, random_model(["x1", "x2"], 6, "bell", "linear"), "y", "huber", Adam(0.05), steps=6)
    return _steps(spark, history)


# With one rule the model is a straight plane, whose fold errors SQL can fit with regr_* functions.
@query("g18_one_rule_folds", f"""WITH {IN_SQL}, f AS (SELECT *, (l_orderkey % 7)::INTEGER AS fold FROM inp),
fit AS (SELECT k::INTEGER AS fold, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM f, range(7) t(k) WHERE f.fold <> k GROUP BY k)
SELECT fold, {R('sum(abs(a + b * x1 - y))', 2)} AS error_sum, {R('avg(abs(a + b * x1 - y))')} AS error_avg, {R('max(abs(a + b * x1 - y))')} AS error_max,
  count(*) AS n_rows FROM f JOIN fit USING (fold) GROUP BY fold""")
def _(spark, d):
    df = points(spark, d).withColumn("fold", (F.col("l_orderkey") % 7).cast("int"))
    one = spaced_model({"x1": (-1.5, 1.5)}, 1)
    out = evaluate_folds(df, "fold", one, "y", ridge=1e-9)
    return out.select("fold", rnd("error_sum", 2).alias("error_sum"), rnd("error_avg").alias("error_avg"),
                      rnd("error_max").alias("error_max"), "n_rows")


@query("g18_leave_one_day_out", f"""WITH {SUP_SQL}, nd AS (SELECT *, dense_rank() OVER (ORDER BY ts::DATE) - 1 AS day_no FROM sup), """
       + fold_sql("nd", "day_no", "click", '"view"', "target_ahead").format(name="day_id"))
def _(spark, d):
    # days count over the whole series: those of a segment begin at 0 again in the next one
    days = number_days(supervised_set(spark, d).drop("day_id"), SENS)
    two = FuzzyModel(("click", "view"), "gauss", GAUSS, paired_rules(2, 2), "proportional", np.zeros(2))
    return _fold_view(evaluate_folds(days, "day_id", two, "target_ahead"), "day_id")


# Two outputs of two constant rules each, from one factor.
@query("g13_two_outputs", f"""WITH {IN_SQL.replace(" AS y,", " AS y, l_tax,")}, {weights_sql(_G, _PAIRED)}, a AS (SELECT w0 / den AS a, w1 / den AS b, y, l_tax FROM ws),
s AS (SELECT sum(a * a) + 1e-3 AS aa, sum(a * b) AS ab, sum(b * b) + 1e-3 AS bb, sum(a * y) AS ay, sum(b * y) AS byy, sum(a * l_tax) AS atax, sum(b * l_tax) AS btax FROM a)
SELECT 'y' AS target, {R('(ay * bb - byy * ab) / (aa * bb - ab * ab)')} AS c0, {R('(byy * aa - ay * ab) / (aa * bb - ab * ab)')} AS c1 FROM s
UNION ALL SELECT 'l_tax', {R('(atax * bb - btax * ab) / (aa * bb - ab * ab)')}, {R('(btax * aa - atax * ab) / (aa * bb - ab * ab)')} FROM s""")
def _(spark, d):
    df = lineitem(spark, d).select(
        "l_tax", (F.col("l_extendedprice") / 10000.0).alias("y"), ((F.col("l_quantity") - 25.5) / 14.5).alias("x1"),
        ((F.col("l_discount") - 0.05) / 0.03).alias("x2"))
    fitted = fit_outputs(df, model(coef=[0.0, 0.0]), ["y", "l_tax"])
    out = spark.createDataFrame([(t, *map(float, m.coef)) for t, (m, _) in fitted.items()], "target string, c0 double, c1 double")
    return out.select("target", rnd("c0").alias("c0"), rnd("c1").alias("c1"))


# The default output kind: one sum per rule and one of the biases are all that a prediction depends on.
@query("g13_linear_outputs", f"""WITH {IN_SQL}, {weights_sql(_G, [[0, 0]])}, a AS (SELECT w0 / den AS a, 1 / den AS b, y FROM ws),
s AS (SELECT sum(a * a) + 1e-3 AS aa, sum(a * b) AS ab, sum(b * b) + 1e-3 AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM a)
SELECT {R('(ay * bb - byy * ab) / (aa * bb - ab * ab)', 3)} AS rule_sum, {R('(byy * aa - ay * ab) / (aa * bb - ab * ab)', 5)} AS bias_sum FROM s""")
def _(spark, d):
    one = FuzzyModel(("x1", "x2"), "gauss", tuple(s[:1] for s in GAUSS), paired_rules(1, 2), "linear", np.zeros((1, 1)), np.zeros(1))
    fitted, _sse = fit_consequents(points(spark, d), one, "y")
    out = spark.createDataFrame([(float(fitted.coef.sum()), float(fitted.bias.sum()))], "c double, b double")
    return out.select(rnd("c", 3).alias("rule_sum"), rnd("b", 5).alias("bias_sum"))


_LAGS = ["lag_18", "lag_12", "lag_6", "lag_0"]
_SPANS = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(_LAGS))
_SERIES_W = [" * ".join(f"exp(-0.5 * pow(({c} - {side}{i}) / ((hi{i} - lo{i}) / 2 + 1e-12), 2))" for i, c in enumerate(_LAGS)) for side in ("lo", "hi")]


# Two constant rules at the ends of every lag's range.
@query("g11_series_prediction", f"""WITH {_EMBED_SQL}, rows_ AS (SELECT * FROM emb4 WHERE target IS NOT NULL AND lag_18 IS NOT NULL),
sp AS (SELECT {_SPANS} FROM rows_), ww AS (SELECT *, {_SERIES_W[0]} AS w0, {_SERIES_W[1]} AS w1 FROM rows_, sp),
sh AS (SELECT *, w0 / least(greatest(w0 + w1, 1e-12), 1e12) AS a, w1 / least(greatest(w0 + w1, 1e-12), 1e12) AS b FROM ww),
ne AS (SELECT sum(a * a) + 1e-3 AS aa, sum(a * b) AS ab, sum(b * b) + 1e-3 AS bb, sum(a * target) AS ay, sum(b * target) AS byy FROM sh)
SELECT slot, {R('target', 2)} AS target, {R('((ay * bb - byy * ab) * a + (byy * aa - ay * ab) * b) / (aa * bb - ab * ab)', 2)} AS prediction FROM sh, ne""")
def _(spark, d):
    df = lag_embed(daily(spark, d), DAILY, "total", 4, 6)
    df = stage(df.where("target IS NOT NULL AND lag_18 IS NOT NULL").select("slot", *_LAGS, "target"))
    ends = init_from_data(df, _LAGS, 2)
    two = FuzzyModel(tuple(_LAGS), "gauss", ends.sets, paired_rules(2, 4), "proportional", np.zeros(2))
    fitted, _sse = fit_consequents(df, two, "target")
    return predict(df, fitted).select("slot", rnd("target", 2).alias("target"), rnd("prediction", 2).alias("prediction"))
