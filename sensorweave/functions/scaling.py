"""Scalers fitted by one aggregate and applied as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minmax_given(x: Column, *, min_val: Column, max_val: Column, feature_range: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Min-max scaling with given bounds (F7); null when the bounds are equal.

    Keyword-only on purpose: swapped bounds silently give one minus the scaled value.
    """
    low, high = feature_range
    return F.try_divide(x - min_val, max_val - min_val) * (high - low) + low


def standard_given(x: Column, *, mean: Column, std: Column) -> Column:
    """Standardise with given parameters (F8); null when ``std`` is 0."""
    return F.try_divide(x - mean, std)


def inverse_standard(z: Column, *, mean: Column, std: Column) -> Column:
    """Undo ``standard_given``."""
    return z * std + mean


@dataclass(frozen=True)
class Scaler:
    """Per-column ``offset`` and ``scale``: ``(x - offset) / scale``. A zero scale counts as 1."""

    params: Mapping[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], kind: str = "standard", ddof: int = 0,
            matrix_wide: bool = False) -> "Scaler":
        """Fit with one aggregate; runs a job that returns one row.

        ``kind``: ``standard`` (population std for ``ddof=0``, sample std for ``ddof=1``) or
        ``minmax``; ``matrix_wide`` uses one minimum and maximum for all columns (F10).
        """
        if kind == "standard":
            std = F.stddev_pop if ddof == 0 else F.stddev_samp
            row = df.agg(*[F.struct(F.avg(c), std(c)).alias(c) for c in cols]).first()
            pairs = {c: tuple(row[c]) for c in cols}
        elif kind == "minmax":
            row = df.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in cols]).first()
            bounds = {c: tuple(row[c]) for c in cols}
            if matrix_wide:
                known = [b for b in bounds.values() if b[0] is not None]
                wide = (min(b[0] for b in known), max(b[1] for b in known))
                bounds = {c: wide for c in cols}
            pairs = {c: (lo, None if lo is None else hi - lo) for c, (lo, hi) in bounds.items()}
        else:
            raise ValueError(f"unknown kind {kind}")
        return cls({c: (0.0 if a is None else float(a), float(s) if s else 1.0) for c, (a, s) in pairs.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - a) / s for c, (a, s) in self.params.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * s + a for c, (a, s) in self.params.items()})


def leave_one_out_stats(df: DataFrame, fold: str, cols: Sequence[str], ddof: int = 1) -> DataFrame:
    """Count, mean and std of every fold's own rows and of all rows outside it (F14, F15), long form.

    Rows: fold, ``is_test``, ``column``, ``n`` (known values), ``mean``, ``std``. One scan makes one mergeable row per
    fold; what lies outside a fold is the sum of what lies before and behind it, so nothing is copied per fold
    and no large sum is taken away from another. A null fold is a fold.
    """
    cols = list(cols)
    own = df.groupBy(fold).agg(*[f(c).alias(f"{name}{i}") for i, c in enumerate(cols)
                                 for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    long = own.select(fold, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.coalesce(f"m{i}", F.lit(0.0)).alias("m"), F.coalesce(f"v{i}", F.lit(0.0)).alias("v"))
        for i, c in enumerate(cols)])))
    # moments about the common mean, one row per fold and column
    every = Window.partitionBy("column")
    centred = long.withColumn("c", F.try_divide(F.sum(F.col("n") * F.col("m")).over(every), F.sum("n").over(every))).withColumns({
        "s": F.col("n") * (F.col("m") - F.col("c")), "q": F.col("n") * (F.col("v") + (F.col("m") - F.col("c")) ** 2)})
    before = every.orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    behind = every.orderBy(fold).rowsBetween(1, Window.unboundedFollowing)
    outside = [(F.coalesce(F.sum(x).over(before), F.lit(0)) + F.coalesce(F.sum(x).over(behind), F.lit(0))).alias(f"o_{x}") for x in ("n", "s", "q")]
    both = centred.select(fold, "column", "c", "n", "s", "q", *outside).select(fold, "column", "c", F.inline(F.array(
        F.struct(F.lit(True).alias("is_test"), F.col("n"), F.col("s"), F.col("q")),
        F.struct(F.lit(False).alias("is_test"), F.col("o_n").alias("n"), F.col("o_s").alias("s"), F.col("o_q").alias("q")))))
    shift = F.try_divide("s", "n")
    var = F.try_divide(F.col("q") - shift * F.col("s"), F.col("n") - ddof)
    return both.select(fold, "is_test", "column", "n", (F.col("c") + shift).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def fold_stats(df: DataFrame, fold: str, cols: Sequence[str], ddof: int = 1) -> DataFrame:
    """Mean and std of every fold's training rows, i.e. all rows outside the fold (F15): fold, ``column``, ``mean``, ``std``."""
    return leave_one_out_stats(df, fold, cols, ddof).where("NOT is_test").select(fold, "column", "mean", "std")


def hash_share(key: Sequence[str], seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the row key alone: the leading 32 bits of the MD5 of seed and key, comma-joined.

    Null parts of a key read as empty. Rows below a threshold are a sample; those below a larger one hold it.
    """
    text = F.concat_ws(",", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(2 ** 32))


def hash_split(df: DataFrame, key: Sequence[str], train_percent: int = 80, seed: int = 42) -> DataFrame:
    """Repeatable random split by row key, the same on any engine: adds ``is_train``."""
    return df.withColumn("is_train", hash_share(key, seed) * 100 < train_percent)


def leave_one_out(df: DataFrame, fold: str, folds: Sequence[int]) -> DataFrame:
    """The rows once per fold in ``folds``, ``is_test`` where the row belongs to that fold.

    The output is ``len(folds)`` times the input; ``leave_one_out_stats`` gives its statistics from one scan.
    """
    numbers = F.explode(F.array(*[F.lit(int(f)) for f in folds]))
    return df.withColumn("fold", numbers).withColumn("is_test", F.col(fold) == F.col("fold"))
