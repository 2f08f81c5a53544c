"""Gradient and hybrid training of a neuro-fuzzy model, against slopes that SQL takes by differences."""

import numpy as np

from sensorweave.catalog.base import R, query, rnd
from sensorweave.catalog.fuzzy import BELL, GAUSS, IN_SQL, model, points
from sensorweave.plans.fuzzy_training import Adam, Momentum, fit_gradient, fit_hybrid, pack
from sensorweave.sources.stage import stage

_H = 1e-4  # half the width of a central difference


def _grade(kind: str, x: str, at: int) -> str:
    if kind == "gauss":
        return f"exp(-0.5 * pow(({x} - p{at}) / (p{at + 1} + 1e-12), 2))"
    return f"(1 / (1 + pow(abs(({x} - p{at + 2}) / (p{at} + 1e-12)), 2 * p{at + 1})))"


def _prediction(kind: str, width: int) -> tuple[str, str, str, int]:
    """Both weights, the prediction of two paired rules with constant outputs, and the number of parameters."""
    w = [f"{_grade(kind, 'x1', j * width)} * {_grade(kind, 'x2', (2 + j) * width)}" for j in (0, 1)]
    n = 4 * width
    return *w, f"(p{n} * w0 + p{n + 1} * w1) / least(greatest(w0 + w1, 1e-12), 1e12)", n + 2


def _losses(t: int, kind: str, width: int, loss: str, rows: str) -> str:
    """``lo``: the loss with every parameter pushed down and up, and as it is; ``gr``: the slopes."""
    w0, w1, pred, n = _prediction(kind, width)
    pushed = ", ".join(f"max(v + CASE WHEN k = j THEN sg * {_H} ELSE 0 END) FILTER (k = {i}) AS p{i}" for i in range(n))
    return f"""pe{t} AS MATERIALIZED (SELECT j, sg, {pushed} FROM th{t}, range({n}) q(j), (VALUES (-1), (0), (1)) s(sg) WHERE sg <> 0 OR j = 0 GROUP BY j, sg),
lo{t} AS MATERIALIZED (SELECT j, sg, {rows}({loss}) AS l FROM (SELECT j, sg, {pred} - y AS e FROM (SELECT *, {w0} AS w0, {w1} AS w1 FROM pe{t}, inp)) GROUP BY j, sg),
gr{t} AS MATERIALIZED (SELECT j AS k, (max(l) FILTER (sg = 1) - max(l) FILTER (sg = -1)) / {2 * _H} AS g FROM lo{t} WHERE sg <> 0 GROUP BY j)"""


def _start(theta) -> str:
    return "th0(k, v, a, b) AS (VALUES " + ", ".join(f"({i}, {float(v)!r}::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE)" for i, v in enumerate(theta)) + ")"


def _descent_sql(kind, width, theta, loss, steps, step) -> str:
    """Full-batch descent; ``step(t)`` gives the new state ``a``, ``b`` and the move, from ``a``, ``b`` and the slope ``g``."""
    parts = [IN_SQL, _start(theta)]
    for t in range(steps):
        a, b, move = step(t + 1)
        parts += [_losses(t, kind, width, loss, "avg"),
                  f"th{t + 1} AS MATERIALIZED (SELECT k, v - ({move}) AS v, a, b FROM (SELECT k, v, {a} AS a, {b} AS b FROM th{t} JOIN gr{t} USING (k)))"]
    out = " UNION ALL ".join([f"SELECT 'loss' AS what, {t} AS k, l AS v FROM lo{t} WHERE sg = 0" for t in range(steps)]
                             + [f"SELECT 'parameter', k::INTEGER, v FROM th{steps}"])
    return f"WITH {', '.join(parts)} SELECT what, k::INTEGER AS k, {R('v', 5)} AS v FROM ({out})"


def _descent_view(spark, fitted, history):
    rows = [("loss", i, float(v)) for i, v in enumerate(history)] + [("parameter", i, float(v)) for i, v in enumerate(pack(fitted))]
    return spark.createDataFrame(rows, "what string, k int, v double").select("what", "k", rnd("v", 5).alias("v"))


def _theta(sets, coef):
    return np.concatenate([*[s.ravel() for s in sets], coef])


_COEF = [2.0, 4.5]


@query("g12_momentum_steps", _descent_sql("gauss", 2, _theta(GAUSS, _COEF), "e * e", 4, lambda t: ("0.5 * a + g", "b", "0.05 * a")))
def _(spark, d):
    df = stage(points(spark, d).select("x1", "x2", "y"))
    return _descent_view(spark, *fit_gradient(df, model(coef=_COEF), "y", "mse", Momentum(0.05, 0.5), steps=4))


def _adam(t):
    return ("0.9 * a + 0.1 * g", "0.999 * b + 0.001 * g * g",
            f"0.05 * (a / (1 - pow(0.9, {t}))) / (sqrt(b / (1 - pow(0.999, {t}))) + 1e-7)")


@query("g12_adam_steps", _descent_sql("bell", 3, _theta(BELL, _COEF), "CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END", 4, _adam))
def _(spark, d):
    df = stage(points(spark, d).select("x1", "x2", "y"))
    return _descent_view(spark, *fit_gradient(df, model(BELL, "bell", coef=_COEF), "y", "huber", Adam(0.05), steps=4))


def _hybrid_sql(theta, epochs, rate):
    """Per epoch the two outputs by normal equations, then one step of length ``rate`` down the slope of the squared error."""
    w0, w1, pred, n = _prediction("gauss", 2)
    parts = [IN_SQL, "st0" + _start(theta)[3:]]
    for t in range(epochs + 1):
        now = ", ".join(f"max(v) FILTER (k = {i}) AS p{i}" for i in range(n))
        parts += [
            f"no{t} AS MATERIALIZED (SELECT {now} FROM st{t})",
            f"""co{t} AS MATERIALIZED (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS c0, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS c1 FROM (
SELECT sum(a * a) + 1e-3 AS aa, sum(a * b) AS ab, sum(b * b) + 1e-3 AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM (
SELECT w0 / least(greatest(w0 + w1, 1e-12), 1e12) AS a, w1 / least(greatest(w0 + w1, 1e-12), 1e12) AS b, y FROM (SELECT {w0} AS w0, {w1} AS w1, y FROM no{t}, inp))))""",
            f"th{t} AS MATERIALIZED (SELECT k, CASE k WHEN {n - 2} THEN c0 WHEN {n - 1} THEN c1 ELSE v END AS v FROM st{t}, co{t})",
            _losses(t, "gauss", 2, "e * e", "sum"),
            f"""st{t + 1} AS MATERIALIZED (SELECT k, v - CASE WHEN k < {n - 2} THEN {rate} * g / (SELECT sqrt(sum(g * g)) FROM gr{t} WHERE k < {n - 2}) ELSE 0 END AS v
FROM th{t} JOIN gr{t} USING (k))"""]
    out = " UNION ALL ".join(f"SELECT {t} AS step, l AS loss FROM lo{t} WHERE sg = 0" for t in range(epochs + 1))
    return f"WITH {', '.join(parts)} SELECT step, {R('loss', 3)} AS loss FROM ({out})"


@query("g14_hybrid_epochs", _hybrid_sql(_theta(GAUSS, [0.0, 0.0]), 3, 0.05))
def _(spark, d):
    df = stage(points(spark, d).select("x1", "x2", "y"))
    _fitted, errors = fit_hybrid(df, model(coef=[0.0, 0.0]), "y", epochs=3, rate=0.05)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(errors)], "step int, loss double").select("step", rnd("loss", 3).alias("loss"))
