"""Neuro-fuzzy models: rules over fuzzy sets, scored as column expressions."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorweave.functions.membership import PARAMS, membership

LOW, HIGH = 1e-12, 1e12  # fixed values: bounds of the sum of rule strengths


@dataclass(frozen=True)
class FuzzyModel:
    """Sets per input, rules that pick one set of every input, and the rule outputs.

    ``sets[i]`` is ``(k_i, parameters)`` for input ``i``; ``rules`` is ``(m, n)`` set numbers.
    ``output``: ``proportional`` with ``coef`` ``(m,)``; ``linear`` with ``coef`` ``(m, m)`` and ``bias``
    ``(m,)``, linear in the strengths; ``sugeno`` with ``coef`` ``(m, n + 1)``, inputs first, then the
    constant. Parameters are a few hundred numbers that live on the driver.
    """

    inputs: tuple[str, ...]
    kind: str
    sets: tuple[np.ndarray, ...]
    rules: np.ndarray
    output: str
    coef: np.ndarray
    bias: np.ndarray | None = None

    def __post_init__(self):
        if len(self.sets) != len(self.inputs):
            raise ValueError("one array of sets per input is needed")
        if any(s.shape[1] != len(PARAMS[self.kind]) for s in self.sets):
            raise ValueError(f"{self.kind} sets have {len(PARAMS[self.kind])} parameters")

    @property
    def n_rules(self) -> int:
        return len(self.rules)

    def with_coef(self, coef: np.ndarray, bias: np.ndarray | None = None) -> "FuzzyModel":
        return replace(self, coef=coef, bias=self.bias if bias is None else bias)


def paired_rules(n_rules: int, n_inputs: int) -> np.ndarray:
    """Rule j uses its own set j of every input."""
    return np.tile(np.arange(n_rules)[:, None], (1, n_inputs))


def grid_rules(counts: Sequence[int]) -> np.ndarray:
    """One rule for every combination of sets."""
    return np.array(list(itertools.product(*[range(c) for c in counts])))


def start_coef(output: str, n_rules: int, n_inputs: int) -> tuple[np.ndarray, np.ndarray | None]:
    if output == "proportional":
        return np.zeros(n_rules), None
    if output == "linear":
        return np.zeros((n_rules, n_rules)), np.zeros(n_rules)
    if output == "sugeno":
        return np.zeros((n_rules, n_inputs + 1)), None
    raise ValueError(f"unknown output {output}")


def spaced_model(bounds: Mapping[str, tuple[float, float]], n_sets: int, kind: str = "gauss",
                 rules: str = "grid", output: str = "sugeno") -> FuzzyModel:
    """Sets evenly spaced over each input's range, width = range / number of sets."""
    sets = []
    for lo, hi in bounds.values():
        width = (hi - lo) / n_sets or 1.0
        centres = np.linspace(lo, hi, n_sets)
        if kind in ("gauss", "gauss_plain"):
            sets.append(np.column_stack([centres, np.full(n_sets, width)]))
        elif kind == "bell":
            sets.append(np.column_stack([np.full(n_sets, width), np.ones(n_sets), centres]))
        elif kind == "sigmoid":
            sets.append(np.column_stack([np.full(n_sets, 1.0 / width), centres]))
        elif kind == "triangle":
            sets.append(np.column_stack([centres - width, centres, centres + width]))
        else:
            raise ValueError(f"no spaced start for {kind}")
    n = len(sets)
    picked = grid_rules([n_sets] * n) if rules == "grid" else paired_rules(n_sets, n)
    coef, bias = start_coef(output, len(picked), n)
    return FuzzyModel(tuple(bounds), kind, tuple(sets), picked, output, coef, bias)


def init_from_data(df: DataFrame, cols: Sequence[str], n_sets: int, kind: str = "gauss", rules: str = "grid",
                   output: str = "sugeno") -> FuzzyModel:
    """``spaced_model`` over the columns' minimum and maximum (G15); runs a job that returns one row."""
    row = df.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in cols]).first()
    return spaced_model({c: (float(row[c][0]), float(row[c][1])) for c in cols}, n_sets, kind, rules, output)


def random_model(inputs: Sequence[str], n_rules: int, kind: str = "gauss", output: str = "proportional",
                 how: str = "uniform", seed: int = 0) -> FuzzyModel:
    """Random paired-rule start for standardised inputs; ``init_from_data`` is the safer choice.

    ``normal`` draws everything around 0, which leaves widths near 0: bell sets are unstable then.
    """
    # Uniform ranges of centres, widths and slopes, rule outputs; std of the normal draw.
    centre, width, result, spread = (-1.5, 1.5), (0.7, 1.3), (-2.0, 2.0), 0.1
    rng = np.random.default_rng(seed)

    def draw(shape, bounds):
        return rng.uniform(*bounds, size=shape) if how == "uniform" else rng.normal(0.0, spread, size=shape)

    if how not in ("uniform", "normal"):
        raise ValueError(f"unknown start {how}")
    bounds = {"mu": centre, "c": centre, "sigma": width, "a": width, "b": width, "gamma": width}
    sets = tuple(np.column_stack([draw(n_rules, bounds[p]) for p in PARAMS[kind]]) for _ in inputs)
    coef, bias = start_coef(output, n_rules, len(inputs))
    return FuzzyModel(tuple(inputs), kind, sets, paired_rules(n_rules, len(inputs)), output, draw(coef.shape, result),
                      None if bias is None else draw(bias.shape, result))


# --- scoring ---------------------------------------------------------------------------------------

def set_memberships(model: FuzzyModel, cols: Sequence[Column] | None = None) -> list[list[Column]]:
    xs = [F.col(c) for c in model.inputs] if cols is None else cols
    return [[membership(x, model.kind, p) for p in sets] for x, sets in zip(xs, model.sets)]


def strengths(df: DataFrame, model: FuzzyModel, out: str = "strengths") -> DataFrame:
    """Add the firing strength of every rule as an array: the product of its memberships.

    Memberships are computed once per set, not once per rule.
    """
    grades = set_memberships(model)
    order = df.columns
    df = df.withColumn("_g", F.array(*[F.array(*g) for g in grades]))
    products = []
    for rule in model.rules:
        product = F.col("_g")[0][int(rule[0])]
        for i in range(1, len(rule)):
            product = product * F.col("_g")[i][int(rule[i])]
        products.append(product)
    return df.withColumn(out, F.array(*products)).select(*order, out)


def _sum(values: Sequence[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total


def total_strength(w: str, n_rules: int) -> Column:
    """Sum of the strengths, kept inside fixed bounds."""
    total = _sum([F.col(w)[r] for r in range(n_rules)])
    return F.least(F.greatest(total, F.lit(LOW)), F.lit(HIGH))


def normalised(df: DataFrame, model: FuzzyModel, out: str = "activation") -> DataFrame:
    """Add every rule's share of the total strength."""
    order = df.columns
    df = strengths(df, model, "_w").withColumn("_den", total_strength("_w", model.n_rules))
    return df.withColumn(out, F.array(*[F.col("_w")[r] / F.col("_den") for r in range(model.n_rules)])).select(*order, out)


def predict(df: DataFrame, model: FuzzyModel, out: str = "prediction") -> DataFrame:
    """Score rows with fitted parameters (G8-G11): generated JVM code, no Python workers.

    A null input gives a null prediction.
    """
    order = [c for c in df.columns if c != out]
    m = model.n_rules
    df = strengths(df, model, "_w").withColumn("_den", total_strength("_w", m))
    w = [F.col("_w")[r] for r in range(m)]
    if model.output == "proportional":
        num = _sum([w[r] * float(model.coef[r]) for r in range(m)])
    elif model.output == "linear":
        per_rule = model.coef.sum(axis=1)
        num = _sum([w[r] * float(per_rule[r]) for r in range(m)]) + float(model.bias.sum())
    else:
        planes = []
        for r in range(m):
            plane = _sum([F.col(c) * float(v) for c, v in zip(model.inputs, model.coef[r])]) + float(model.coef[r, -1])
            planes.append(w[r] * plane)
        num = _sum(planes)
    known = F.col(model.inputs[0]).isNotNull()
    for c in model.inputs[1:]:
        known = known & F.col(c).isNotNull()
    return df.withColumn(out, F.when(known, num / F.col("_den"))).select(*order, out)


def predict_many(df: DataFrame, models: Mapping[str, FuzzyModel]) -> DataFrame:
    """Several outputs for the same rows, one model each (G10 with more than one output)."""
    for name, model in models.items():
        df = predict(df, model, name)
    return df


def mean_activation(df: DataFrame, model: FuzzyModel) -> DataFrame:
    """Mean share of every rule over all rows."""
    shares = normalised(df, model, "_a").where(F.col("_a")[0].isNotNull())
    means = F.array(*[F.avg(F.col("_a")[r]) for r in range(model.n_rules)])
    return shares.agg(means.alias("_m")).select(F.posexplode("_m").alias("rule", "activation"))


def membership_curves(spark: SparkSession, model: FuzzyModel, bounds: Mapping[str, tuple[float, float]], points: int = 101) -> DataFrame:
    """Membership of every set on an even grid over each input's range."""
    out = None
    for i, name in enumerate(model.inputs):
        lo, hi = bounds[name]
        grid = spark.range(points).select(F.lit(name).alias("input"), (F.col("id") * ((hi - lo) / (points - 1)) + lo).alias("x"))
        grades = F.array(*[membership(F.col("x"), model.kind, p) for p in model.sets[i]])
        part = grid.select("input", "x", F.posexplode(grades).alias("set", "grade"))
        out = part if out is None else out.unionByName(part)
    return out
