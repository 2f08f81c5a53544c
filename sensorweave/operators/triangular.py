"""Least squares from triangular factors: tasks reduce their rows to an R, a tree of tasks reduces the Rs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.sources.stage import stage

#: Factors that one task merges at once, and rows that are gathered before they are reduced.
FAN, GATHER = 64, 4096


def reduced(blocks: Sequence[np.ndarray], width: int) -> np.ndarray:
    """The R (width x width, upper triangular) of the blocks stacked: R'R is the sum of the blocks' B'B."""
    stacked = np.vstack([np.zeros((0, width)), *blocks])
    out = np.zeros((width, width))
    if len(stacked):
        r = np.linalg.qr(stacked, mode="r")
        out[:len(r)] = r
    return out


def _rows(r: dict, width: int, part: int | None = None) -> pa.RecordBatch:
    names = list(r)
    data = {"fold": pa.array([float(k) for k in names], pa.float64()), "part": pa.array([part or 0] * len(names), pa.int64()),
            "n": pa.array([r[k][1] for k in names], pa.int64()),
            "r": pa.array([r[k][0].ravel().tolist() for k in names], pa.list_(pa.float64()))}
    return pa.RecordBatch.from_pydict(data)


SCHEMA = "fold double, part long, n long, r array<double>"


def factors(df: DataFrame, cols: Sequence[str], width: int, design: Callable[[np.ndarray], dict[float, np.ndarray]]) -> DataFrame:
    """One R per key that ``design`` names: ``fold, n, r`` (row-major ``width x width``).

    ``design`` turns complete rows of ``cols`` into design rows by key. A task holds one R per key and gathers rows
    before each reduction; Rs are then merged ``FAN`` at a time, by key, until each key has one. No product
    of columns is formed, so the result keeps the digits that normal equations lose.
    """
    names = list(dict.fromkeys(cols))

    def run(batches):
        from pyspark import TaskContext

        held: dict[float, list] = {}
        for b in batches:
            x = np.column_stack([np.asarray(b.column(c).cast(pa.float64()).fill_null(np.nan)) for c in names])
            x = x[~np.isnan(x).any(axis=1)]
            for key, rows in design(x).items() if len(x) else ():
                r, n, wait = held.get(key, (np.zeros((0, width)), 0, []))
                wait = [*wait, rows]
                if sum(map(len, wait)) >= GATHER:
                    r, wait = reduced([r, *wait], width), []
                held[key] = (r, n + len(rows), wait)
        if held:
            yield _rows({k: (reduced([r, *wait], width), n) for k, (r, n, wait) in held.items()}, width, TaskContext.get().partitionId())

    return merged(df.select(*names).mapInArrow(run, SCHEMA), width)


def merged(parts: DataFrame, width: int) -> DataFrame:
    """One factor per ``fold`` out of many, by rounds of ``FAN``: a group never holds more than that many."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = reduced([np.array(v).reshape(width, width) for v in pdf["r"]], width)
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "part": pdf["part"].iloc[:1], "n": [int(pdf["n"].sum())], "r": [r.ravel().tolist()]})

    now = stage(parts, "factors")
    while True:
        most = now.agg(F.max("part")).first()[0]
        up = now.withColumn("part", F.expr(f"part div {FAN}")).groupBy("fold", "part").applyInPandas(merge, SCHEMA)
        if most is None or most < FAN:
            return up.drop("part")
        now = stage(up, "factors")


def all_but_one(one: DataFrame, width: int, blocks: int | None = None) -> DataFrame:
    """For each ``fold`` the factor of all rows outside it: ``fold, n, r`` of the others.

    Folds are dealt into about the square root of their number of blocks. A block's factor is merged from its folds;
    what lies outside a block is merged from prefixes and suffixes of the blocks' factors, and what lies outside
    a fold from those of the block. Nothing is ever taken away from a sum. The driver holds one factor per block.
    """
    one = stage(one, "factors-folds")
    blocks = blocks or max(1, round(one.count() ** 0.5))
    dealt = one.withColumn("part", F.pmod(F.xxhash64("fold"), F.lit(blocks)))
    whole = merged(dealt.select(F.col("part").cast("double").alias("fold"), F.lit(0).cast("long").alias("part"), "n", "r"), width).collect()
    known = {int(w["fold"]): (np.array(w["r"]).reshape(width, width), w["n"]) for w in whole}

    def others(items: list[tuple], outside: tuple) -> list[tuple]:
        """Of (key, R, n): the merge of all but each, with ``outside``."""
        suffix = [outside]
        for _, r, n in reversed(items[1:]):
            suffix.append((reduced([suffix[-1][0], r], width), suffix[-1][1] + n))
        out, prefix = [], (np.zeros((0, width)), 0)
        for (key, r, n), (rest, m) in zip(items, reversed(suffix)):
            out.append((key, reduced([prefix[0], rest], width), prefix[1] + m))
            prefix = (reduced([prefix[0], r], width), prefix[1] + n)
        return out

    outside = {k: (r, n) for k, r, n in others([(k, *v) for k, v in sorted(known.items())], (np.zeros((0, width)), 0))}

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        items = [(f, np.array(r).reshape(width, width), int(n)) for f, r, n in zip(pdf["fold"], pdf["r"], pdf["n"])]
        made = others(items, outside[int(pdf["part"].iloc[0])])
        return pd.DataFrame({"fold": [k for k, _, _ in made], "n": [n for _, _, n in made], "r": [r.ravel().tolist() for _, r, _ in made]})

    return dealt.groupBy("part").applyInPandas(within, "fold double, n long, r array<double>")


def solved(r: np.ndarray, targets: int = 1, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (p x targets) and sums of squared errors of the least squares whose rows, targets last, have the factor ``r``.

    ``ridge`` adds rows of its root to the factor. Directions that the rows leave open get the shortest solution.
    """
    p = r.shape[1] - targets
    a, b = r[:, :p], r[:, p:]
    if ridge:
        a, b = np.vstack([a, np.sqrt(ridge) * np.eye(p)]), np.vstack([b, np.zeros((p, targets))])
    coef = np.linalg.lstsq(a, b, rcond=None)[0]
    error = r[:, :p] @ coef - r[:, p:]
    return coef, (error ** 2).sum(axis=0)
