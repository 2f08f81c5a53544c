"""Fuzzy membership functions as column expressions (G1-G4) and as NumPy with closed-form partials."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameter names by kind, and the guard added to a width before dividing.
PARAMS = {
    "gauss": ("mu", "sigma"),
    "gauss_plain": ("mu", "sigma"),
    "bell": ("a", "b", "c"),
    "sigmoid": ("gamma", "c"),
    "triangle": ("a", "b", "c"),
    "trapezoid": ("a", "b", "c", "d"),
}
GUARD = 1e-12


def membership(x: Column, kind: str, params: Sequence[float]) -> Column:
    """Degree of membership in [0, 1].

    ``gauss`` exp(-(x-mu)^2 / 2 sigma^2) (G1); ``gauss_plain`` the same without the half; ``bell``
    1 / (1 + |(x-c)/a|^2b) (G2); ``triangle`` and ``trapezoid`` with feet open on the left (G3);
    ``sigmoid`` 1 / (1 + exp(-gamma (x-c))) (G4; the published text forgets the "1 +").
    """
    p = [float(v) for v in params]
    if kind in ("gauss", "gauss_plain"):
        mu, sigma = p
        z = (x - mu) / (sigma + GUARD)
        return F.exp(z * z * (-0.5 if kind == "gauss" else -1.0))
    if kind == "bell":
        a, b, c = p
        return 1.0 / (1.0 + F.pow(F.abs((x - c) / (a + GUARD)), F.lit(2.0 * b)))
    if kind == "sigmoid":
        gamma, c = p
        return 1.0 / (1.0 + F.exp((x - c) * -gamma))
    if kind == "triangle":
        a, b, c = p
        if not a <= b <= c:
            raise ValueError("triangle needs a <= b <= c")
        out = F.when(x.isNull(), F.lit(None).cast("double"))
        if a < b:
            out = out.when((x > a) & (x <= b), (x - a) / (b - a))
        if b < c:
            out = out.when((x > b) & (x <= c), (c - x) / (c - b))
        return out.otherwise(0.0)
    if kind == "trapezoid":
        a, b, c, d = p
        if not a <= b <= c <= d:
            raise ValueError("trapezoid needs a <= b <= c <= d")
        # A vertical side does not belong to the set, unless the other side's top stands on it.
        up = (x >= b if b == c < d else x > b).cast("double") if a == b else (x - a) / (b - a)
        down = (x <= c if a < b == c else x < c).cast("double") if c == d else (d - x) / (d - c)
        return F.when(F.isnan(x), 0.0).when(x.isNotNull(), F.greatest(F.least(up, down, F.lit(1.0)), F.lit(0.0)))
    raise ValueError(f"unknown membership {kind}")


def evaluate(x: np.ndarray, kind: str, params: np.ndarray) -> np.ndarray:
    """Memberships ``(n, k)`` of values ``x`` in ``k`` sets, for the kinds that can be trained."""
    p = params.T[:, None, :]
    v = x[:, None]
    if kind in ("gauss", "gauss_plain"):
        z = (v - p[0]) / (p[1] + GUARD)
        return np.exp(z * z * (-0.5 if kind == "gauss" else -1.0))
    if kind == "bell":
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.abs((v - p[2]) / (p[0] + GUARD)) ** (2.0 * p[1]))
    if kind == "sigmoid":
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-p[0] * (v - p[1])))
    raise ValueError(f"membership {kind} cannot be trained")


def partials(x: np.ndarray, kind: str, params: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Derivatives ``(n, k, parameters)`` of the memberships ``m`` with respect to each parameter."""
    p = params.T[:, None, :]
    v = x[:, None]
    if kind in ("gauss", "gauss_plain"):
        s = p[1] + GUARD
        gap = v - p[0]
        factor = 1.0 if kind == "gauss" else 2.0
        return np.stack([factor * m * gap / s ** 2, factor * m * gap ** 2 / s ** 3], axis=2)
    if kind == "bell":
        a, b = p[0] + GUARD, p[1]
        gap = v - p[2]
        t = np.abs(gap / a)
        # With u = t^(2b), m = 1 / (1 + u), so m^2 u = m (1 - m) stays finite however large u is.
        mu = m * (1.0 - m)
        log_t = np.log(np.where(t > 0, t, 1.0))
        over = np.where(gap != 0, 1.0 / np.where(gap != 0, gap, 1.0), 0.0)
        return np.stack([2 * b * mu / a, -2 * mu * log_t, 2 * b * mu * over], axis=2)
    if kind == "sigmoid":
        slope = m * (1.0 - m)
        return np.stack([slope * (v - p[1]), -p[0] * slope], axis=2)
    raise ValueError(f"membership {kind} cannot be trained")
