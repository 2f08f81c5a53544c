"""Reports on whole tables: gaps, missing values, dispersion, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorweave.operators.ordered import add_slot, minute_gaps, run_lengths
from sensorweave.operators.quantiles import column_quantiles, exact_quantiles
from sensorweave.spec import MICROS, SERIES, SeriesSpec, micros, null_safe, pack, unpack


def gap_histogram(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Number of row-to-row steps by whole minutes (A10)."""
    df = minute_gaps(df, spec)
    return (df.where("gap_min IS NOT NULL").groupBy(*spec.keys, F.floor("gap_min").alias("gap_min"))
            .agg(F.count(F.lit(1)).alias("n")))


@null_safe
def context_rows(df: DataFrame, spec: SeriesSpec, min_gap: float, reach: int) -> DataFrame:
    """Rows ``[hit - reach, hit + reach)`` around each row that follows a gap of more than ``min_gap`` minutes.

    Each hit names the slots it wants; those are matched with the rows by an equi-join on the slot.
    """
    rows = add_slot(minute_gaps(df, spec), spec)
    hits = rows.where(F.col("gap_min") > min_gap).select(*spec.keys, F.col(spec.slot).alias("hit_slot"))
    wanted = hits.withColumn(spec.slot, F.explode(F.sequence(
        F.col("hit_slot") - reach, F.col("hit_slot") + (reach - 1))))
    return rows.join(wanted, [*spec.keys, spec.slot])


def missing_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of nulls per column in percent, columns without nulls left out, largest first."""
    ratios = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    return ratios.unpivot([], list(cols), "column", "missing_pct").where("missing_pct > 0").orderBy(
        F.desc("missing_pct"), "column")


def segment_report(df: DataFrame, spec: SeriesSpec, target: str) -> DataFrame:
    """Rows, nulls in ``target``, its longest null run, whole days covered."""
    runs = run_lengths(df, spec, F.col(target).isNull())
    t = micros(spec.ts)
    return runs.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(target).isNull().cast("long")).alias("nulls"),
        F.coalesce(F.max(F.when(F.col(target).isNull(), F.col("run_len"))), F.lit(0).cast("long")).alias("longest_null_run"),
        F.floor((F.max(t) - F.min(t)) / (86_400 * MICROS)).alias("days"))


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, median, population std, min and max of each column, one row per column."""
    aggs = [f(c).alias(f"{name}{i}") for i, c in enumerate(cols)
            for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    wide = df.agg(*aggs)
    stats = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[
        F.col(f"{name}{i}").cast("double").alias(name) for name in ("mean", "std", "min", "max")]) for i, c in enumerate(cols)])))
    medians = column_quantiles(df, cols, [0.5]).select("column", F.col("q").alias("median"))
    return stats.join(F.broadcast(medians), "column", "left")  # one row per column of the input


def dispersion(df: DataFrame, features: str, by: Sequence[str] = ()) -> DataFrame:
    """Variance, std (population), interquartile range and range over all cells of ``features``."""
    by = list(by)
    if by and by != [SERIES]:  # null groups are groups
        return unpack(dispersion(pack(df.select(*by, features), by), features, [SERIES]), by)
    cells = df.select(*by, F.explode(features).alias("_cell"))
    stats = cells.groupBy(*by).agg(F.var_pop("_cell").alias("variance"), F.stddev_pop("_cell").alias("std"),
                                   (F.max("_cell") - F.min("_cell")).alias("range"))
    q = exact_quantiles(cells, "_cell", [0.25, 0.75], by)
    sign = F.when(F.col("p") > 0.5, F.col("q")).otherwise(-F.col("q"))
    iqr = q.groupBy(*by).agg(F.sum(sign).alias("iqr"))
    return stats.join(iqr, by) if by else stats.crossJoin(iqr)


def centroid(df: DataFrame, features: str, dim: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean vector per group (first half of A15)."""
    means = F.array(*[F.avg(F.col(features)[i]) for i in range(dim)])
    return df.groupBy(*by).agg(means.alias("centroid"))


def centroid_spread(df: DataFrame, features: str, dim: int) -> DataFrame:
    """Mean and population std of the distances to the centroid (A15). The centroid is one row."""
    center = centroid(df, features, dim)
    sq = F.zip_with(features, "centroid", lambda a, b: (a - b) * (a - b))
    dist = F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, v: s + v))
    return df.crossJoin(F.broadcast(center)).agg(F.avg(dist).alias("mean_distance"), F.stddev_pop(dist).alias("centroid_std"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, pairwise complete, long form."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells: list[Column] = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(f"`{i}`").alias("corr")))
    return row.select(F.inline(F.array(*cells)))


def corr_with(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each column with ``target``."""
    row = df.agg(*[F.corr(c, target).alias(c) for c in cols])
    return row.unpivot([], list(cols), "column", "corr")
