"""Fitting neuro-fuzzy models: sums per partition, small updates on the driver.

Every pass over the data is one job in which a partition returns sums whose size depends on the
model alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.functions.membership import evaluate, partials
from sensorweave.functions.scaling import Scaler, fold_stats
from sensorweave.sources.stage import stage as stage_table
from sensorweave.operators.fuzzy import HIGH, LOW, FuzzyModel, predict, start_coef
from sensorweave.operators.triangular import all_but_one, factors, solved


def _matrix(batch, names: Sequence[str]) -> np.ndarray:
    cols = [np.asarray(batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).fill_null(np.nan)) for c in names]
    x = np.column_stack(cols)
    return x[~np.isnan(x).any(axis=1)]


def _summed(df: DataFrame, cols: Sequence[str], fn) -> dict[int, float]:
    """Sum over all partitions of the vectors ``fn`` returns for each batch of complete rows."""
    names = list(dict.fromkeys(cols))

    def run(batches):
        total = None
        for batch in batches:
            x = _matrix(batch, names)
            if len(x):
                part = fn(x)
                total = part if total is None else total + part
        if total is not None:
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], names=["i", "v"])

    sums = df.select(*names).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    return {r.i: r.v for r in sums.collect()}


def _dense(sums: dict[int, float], size: int) -> np.ndarray:
    out = np.zeros(size)
    for i, v in sums.items():
        out[i] = v
    return out


# --- the forward pass and its gradient, on a batch ----------------------------------------------------

def forward(x: np.ndarray, model: FuzzyModel):
    """Prediction plus what the gradient needs."""
    grades = [evaluate(x[:, i], model.kind, s) for i, s in enumerate(model.sets)]
    used = np.stack([g[:, model.rules[:, i]] for i, g in enumerate(grades)], axis=2)  # rows, rules, inputs
    w = used.prod(axis=2)
    raw = w.sum(axis=1)
    den = np.clip(raw, LOW, HIGH)
    if model.output == "proportional":
        per_rule, num = np.broadcast_to(model.coef, w.shape), w @ model.coef
    elif model.output == "linear":
        c = model.coef.sum(axis=1)
        per_rule, num = np.broadcast_to(c, w.shape), w @ c + model.bias.sum()
    else:
        per_rule = x @ model.coef[:, :-1].T + model.coef[:, -1]
        num = (w * per_rule).sum(axis=1)
    return num / den, (grades, used, w, raw, den, per_rule)


def loss_and_slope(error: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Per-row loss and its derivative by the prediction."""
    if loss in ("mse", "sse"):
        return error ** 2, 2 * error
    if loss == "huber":
        size = np.abs(error)
        return np.where(size <= 1, 0.5 * error ** 2, size - 0.5), np.clip(error, -1, 1)
    raise ValueError(f"unknown loss {loss}")


def gradient(x: np.ndarray, y: np.ndarray, model: FuzzyModel, loss: str) -> np.ndarray:
    """Flat sum over rows: premise partials, consequent partials, loss, row count."""
    pred, (grades, used, w, raw, den, per_rule) = forward(x, model)
    value, slope = loss_and_slope(pred - y, loss)
    g = slope / den
    if model.output == "proportional":
        d_coef = (g[:, None] * w).sum(axis=0)
        tail = [d_coef]
    elif model.output == "linear":
        d_rule = (g[:, None] * w).sum(axis=0)
        tail = [np.repeat(d_rule, model.n_rules), np.full(model.n_rules, g.sum())]
    else:
        plus = np.column_stack([x, np.ones(len(x))])
        tail = [((g[:, None] * w).T @ plus).ravel()]
    inside = ((raw > LOW) & (raw < HIGH)).astype(float)
    d_w = g[:, None] * (per_rule - (pred * inside)[:, None])
    head = []
    n_inputs = len(model.sets)
    for i, sets in enumerate(model.sets):
        others = np.delete(used, i, axis=2).prod(axis=2) if n_inputs > 1 else np.ones_like(w)
        by_set = np.zeros_like(grades[i])
        pull = d_w * others
        for r, s in enumerate(model.rules[:, i]):
            by_set[:, s] += pull[:, r]
        head.append((by_set[:, :, None] * partials(x[:, i], model.kind, sets, grades[i])).sum(axis=0).ravel())
    return np.concatenate([*head, *[t.ravel() for t in tail], [value.sum(), len(x)]])


def pack(model: FuzzyModel) -> np.ndarray:
    parts = [s.ravel() for s in model.sets] + [model.coef.ravel()]
    return np.concatenate(parts + ([model.bias] if model.output == "linear" else []))


def unpack(model: FuzzyModel, theta: np.ndarray) -> FuzzyModel:
    at, sets = 0, []
    for s in model.sets:
        sets.append(theta[at:at + s.size].reshape(s.shape))
        at += s.size
    coef = theta[at:at + model.coef.size].reshape(model.coef.shape)
    at += model.coef.size
    return replace(model, sets=tuple(sets), coef=coef, bias=theta[at:] if model.output == "linear" else model.bias)


def total_gradient(df: DataFrame, model: FuzzyModel, target: str, loss: str) -> tuple[float, np.ndarray, int]:
    """Loss, gradient and row count over the whole table (one job). ``mse`` and ``huber`` are means."""
    size = len(pack(model))

    def fn(x):
        return gradient(x[:, :-1], x[:, -1], model, loss)

    sums = _dense(_summed(df, [*model.inputs, target], fn), size + 2)
    n = int(sums[-1])
    if n == 0:
        raise ValueError("no complete rows to train on")
    scale = 1.0 if loss == "sse" else 1.0 / n
    return sums[-2] * scale, sums[:-2] * scale, n


# --- fitting ---------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Adam:
    lr: float = 1e-2
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-7

    def start(self, size: int):
        return np.zeros(size), np.zeros(size)

    def step(self, t: int, grad: np.ndarray, state):
        m, v = state
        m = self.beta1 * m + (1 - self.beta1) * grad
        v = self.beta2 * v + (1 - self.beta2) * grad ** 2
        move = self.lr * (m / (1 - self.beta1 ** t)) / (np.sqrt(v / (1 - self.beta2 ** t)) + self.eps)
        return move, (m, v)


@dataclass(frozen=True)
class Momentum:
    lr: float = 1e-4
    momentum: float = 0.99

    def start(self, size: int):
        return np.zeros(size)

    def step(self, t: int, grad: np.ndarray, state):
        state = self.momentum * state + grad
        return self.lr * state, state


def fit_gradient(df: DataFrame, model: FuzzyModel, target: str, loss: str = "mse", optimizer=Adam(),
                 steps: int = 50) -> tuple[FuzzyModel, list[float]]:
    """Full-batch gradient descent on all parameters (G12): one job per step. Cache ``df`` beforehand."""
    theta = pack(model)
    state = optimizer.start(len(theta))
    history = []
    for t in range(1, steps + 1):
        value, grad, _ = total_gradient(df, unpack(model, theta), target, loss)
        history.append(value)
        move, state = optimizer.step(t, grad, state)
        theta = theta - move
    return unpack(model, theta), history


def _design(x: np.ndarray, model: FuzzyModel) -> np.ndarray:
    """Rows whose product with the free rule coefficients is the prediction.

    A ``linear`` output depends on the sums of its coefficients and of its biases alone: one column per rule and one more.
    """
    _, (_, _, w, _, den, _) = forward(x, model)
    share = w / den[:, None]
    if model.output == "proportional":
        return share
    if model.output == "linear":
        return np.column_stack([share, 1 / den])
    plus = np.column_stack([x, np.ones(len(x))])
    return (share[:, :, None] * plus[:, None, :]).reshape(len(x), -1)


def _free(model: FuzzyModel) -> int:
    """Columns of the design."""
    return model.n_rules + 1 if model.output == "linear" else model.coef.size


def _with_solution(model: FuzzyModel, c: np.ndarray) -> FuzzyModel:
    """The model with the coefficients of its design; sums that a ``linear`` output needs are spread evenly."""
    m = model.n_rules
    if model.output == "linear":
        return model.with_coef(np.repeat(c[:m, None] / m, m, axis=1), np.full(m, c[m] / m))
    return model.with_coef(c.reshape(model.coef.shape))


def fit_outputs(df: DataFrame, model: FuzzyModel, targets: Sequence[str], ridge: float = 1e-3) -> dict[str, tuple[FuzzyModel, float]]:
    """Least squares for the rule outputs of several targets in one pass, the sets held fixed.

    Per target the model and its sum of squared errors. Each task reduces its rows to a triangular factor and a tree
    of tasks merges them; one small factor reaches the driver. Rows with a null input or target are left out.
    """
    targets = list(targets)
    n, k = len(model.inputs), len(targets)
    width = _free(model) + k

    def design(x):
        return {0.0: np.column_stack([_design(x[:, at[:n]], model), x[:, at[n:]]])}

    cols = [*model.inputs, *targets]
    names = list(dict.fromkeys(cols))
    at = np.array([names.index(c) for c in cols])
    got = factors(df, names, width, design).collect()  # one row
    if not got:
        raise ValueError("no complete rows to train on")
    coef, sse = solved(np.array(got[0]["r"]).reshape(width, width), k, ridge)
    return {t: (_with_solution(model, coef[:, i]), float(sse[i])) for i, t in enumerate(targets)}


def fit_consequents(df: DataFrame, model: FuzzyModel, target: str, ridge: float = 1e-3) -> tuple[FuzzyModel, float]:
    """``fit_outputs`` of one target: the model and the sum of squared errors.

    The ridge matches a recursive estimator started at 1000 times the identity.
    """
    return fit_outputs(df, model, [target], ridge)[target]


def adapt_rate(rate: float, errors: Sequence[float]) -> float:
    """Step size rule: three falls in a row raise it; fall, fall, rise, fall lowers it."""
    fall = [b < a for a, b in zip(errors, errors[1:])]
    if len(fall) >= 3 and all(fall[-3:]):
        rate *= 1.1
    if len(fall) >= 4 and fall[-4:] == [True, True, False, True]:
        rate *= 0.9
    return rate


def fit_hybrid(df: DataFrame, model: FuzzyModel, target: str, epochs: int = 5, rate: float = 0.01,
               ridge: float = 1e-3, tolerance: float = 1e-12) -> tuple[FuzzyModel, list[float]]:
    """Least squares for the rule outputs, then one gradient step on the sets, per epoch (G14): two jobs each.

    The step is ``rate`` long in the direction of the gradient; training ends below ``tolerance`` squared error per row. A step that leaves the sets
    unusable (a width that is not positive) keeps that parameter as it was. Returns the best model met
    and the sum of squared errors after every least-squares step.
    """
    errors: list[float] = []
    n_premise = sum(s.size for s in model.sets)
    best: tuple[float, FuzzyModel] | None = None
    for epoch in range(epochs + 1):
        model, sse = fit_consequents(df, model, target, ridge)
        errors.append(sse)
        if best is None or sse < best[0]:
            best = sse, model
        if epoch == epochs:
            break
        _, grad, n_rows = total_gradient(df, model, target, "sse")
        if sse < tolerance * n_rows:
            break
        grad = grad[:n_premise]
        rate = adapt_rate(rate, errors)
        size = float(np.linalg.norm(grad))
        eta = rate / size if size > 0 else rate
        theta = pack(model)
        moved = unpack(model, np.concatenate([theta[:n_premise] - eta * grad, theta[n_premise:]]))
        width = {"gauss": 1, "gauss_plain": 1, "bell": 0}.get(model.kind)
        if width is not None:
            sets = []
            for old, new in zip(model.sets, moved.sets):
                new = new.copy()
                new[:, width] = np.where(new[:, width] > 0, new[:, width], old[:, width])
                sets.append(new)
            moved = replace(moved, sets=tuple(sets))
        model = moved
    return best[1], errors


def score_candidates(df: DataFrame, candidates: Sequence[FuzzyModel], target: str) -> DataFrame:
    """Half the sum of squared errors of each candidate model (G16): one pass for all of them."""
    models = list(candidates)
    inputs = models[0].inputs

    def run(batches):
        cost = np.zeros(len(models))
        for batch in batches:
            x = _matrix(batch, [*inputs, target])
            for i, m in enumerate(models):
                e = forward(x[:, :-1], m)[0] - x[:, -1]
                cost[i] += (e @ e) / 2
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), pa.array(cost)],
                                         names=["candidate", "cost"])

    parts = df.select(*inputs, target).mapInArrow(run, "candidate int, cost double")
    return parts.groupBy("candidate").agg(F.sum("cost").alias("cost"))


def evaluate_folds(df: DataFrame, fold: str, model: FuzzyModel, target: str, ridge: float = 1e-3,
                   folds_per_pass: int = 64, scaling: str = "others",
                   stage: Callable[[DataFrame], DataFrame] = stage_table) -> DataFrame:
    """Leave one fold out (G18): scale, fit on the other folds, score the fold, undo the scaling.

    ``model`` holds sets for standardised inputs. With ``scaling="others"`` each fold is scaled by the rows outside it, so
    a row has another design for each fold: one pass makes the factors of up to ``folds_per_pass`` folds at once. With
    ``"whole"`` all folds share the scale of the whole table and a row has one design: one pass makes one factor per
    fold, whatever their number, and those of all but one come from merges (``all_but_one``). The rows are never
    copied once per fold. Output: fold, ``error_sum``, ``error_avg``, ``error_max``, ``n_rows``.
    """
    if scaling not in ("others", "whole"):
        raise ValueError(f"unknown scaling {scaling}")
    inputs, cols = list(model.inputs), list(dict.fromkeys([*model.inputs, target]))
    at = [cols.index(c) + 1 for c in [*inputs, target]]
    df = stage(df.select(fold, *cols))
    stats: dict[int, dict[str, tuple[float, float]]] = {}
    for r in fold_stats(df, fold, cols, ddof=1).collect():  # folds x columns rows
        stats.setdefault(int(r[fold]), {})[r["column"]] = (r["mean"], r["std"] or 1.0)
    scale = {f: (np.array([s[c][0] for c in [*inputs, target]]), np.array([s[c][1] for c in [*inputs, target]])) for f, s in stats.items()}
    if scaling == "whole":
        whole = Scaler.fit(df, cols, "standard", ddof=1).params
        same = tuple(np.array([whole[c][i] for c in [*inputs, target]]) for i in (0, 1))
        scale = dict.fromkeys(scale, same)
    coef, bias = start_coef(model.output, model.n_rules, len(inputs))
    blank = model.with_coef(coef, bias)
    width = _free(blank) + 1
    numbered = df.select(F.col(fold).cast("double").alias("_fold"), *cols)

    def rows_of(x, f):
        z = (x[:, at] - scale[f][0]) / scale[f][1]
        return np.column_stack([_design(z[:, :-1], blank), z[:, -1]])

    ids = sorted(scale)
    passes = []
    if scaling == "whole":
        own = factors(numbered, ["_fold", *cols], width, lambda x: {f: rows_of(x[x[:, 0] == f], int(f)) for f in np.unique(x[:, 0])})
        passes.append(all_but_one(own, width))
    else:
        for start in range(0, len(ids), folds_per_pass):
            mine = ids[start:start + folds_per_pass]

            def design(x, mine=mine):
                rest = {float(f): x[x[:, 0] != f] for f in mine}
                return {f: rows_of(part, int(f)) for f, part in rest.items() if len(part)}

            passes.append(factors(numbered, ["_fold", *cols], width, design))
    fitted = {}
    for part in passes:
        for r in part.where("n > 0").toLocalIterator():  # one small factor per fold, one partition at a time
            fitted[int(r["fold"])] = _with_solution(blank, solved(np.array(r["r"]).reshape(width, width), 1, ridge)[0][:, 0])

    def score(batches):
        for batch in batches:
            x = _matrix(batch, ["_fold", *cols])
            error = np.full(len(x), np.nan)
            for f in np.unique(x[:, 0]):
                m = fitted.get(int(f))
                if m is not None:
                    hit = x[:, 0] == f
                    mu, sd = scale[int(f)]
                    z = (x[hit][:, at] - mu) / sd
                    error[hit] = np.abs(forward(z[:, :-1], m)[0] * sd[-1] + mu[-1] - x[hit, at[-1]])
            ok = ~np.isnan(error)
            yield pa.RecordBatch.from_arrays([pa.array(x[ok, 0].astype(np.int32)), pa.array(error[ok])], names=[fold, "e"])

    rows = numbered.mapInArrow(score, f"{fold} int, e double")
    return rows.groupBy(fold).agg(F.sum("e").alias("error_sum"), F.avg("e").alias("error_avg"),
                                  F.max("e").alias("error_max"), F.count("e").alias("n_rows"))


def evaluate_folds_with(df: DataFrame, fold: str, model: FuzzyModel, target: str,
                        fit: Callable[[DataFrame, FuzzyModel], FuzzyModel],
                        stage: Callable[[DataFrame], DataFrame] = stage_table) -> DataFrame:
    """``evaluate_folds`` for any training routine: ``fit(scaled training rows, model)`` runs once per fold.

    One fold after the other, each fit distributed; for gradient or hybrid training of a few folds.
    """
    cols = list(dict.fromkeys([*model.inputs, target]))
    df = stage(df.select(fold, *cols).dropna())
    stats: dict[int, dict[str, tuple[float, float]]] = {}
    for r in fold_stats(df, fold, cols, ddof=1).collect():  # folds x columns rows
        stats.setdefault(int(r[fold]), {})[r["column"]] = (r["mean"], r["std"] or 1.0)
    out = None
    for f in sorted(stats):
        scaler = Scaler(stats[f])
        fitted = fit(scaler.transform(df.where(F.col(fold) != f)), model)
        mean, std = stats[f][target]
        test = predict(scaler.transform(df.where(F.col(fold) == f)), fitted)
        test = test.select(fold, (F.col(target) * std + mean).alias("_y"), (F.col("prediction") * std + mean).alias("_p"))
        e = F.abs(F.col("_y") - F.col("_p"))
        part = test.groupBy(fold).agg(F.sum(e).alias("error_sum"), F.avg(e).alias("error_avg"),
                                      F.max(e).alias("error_max"), F.count(e).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out
