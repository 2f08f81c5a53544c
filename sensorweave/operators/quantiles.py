"""Exact quantiles without holding a group's values in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorweave.spec import SERIES, pack, unpack

BUCKETS = 1024


def range_buckets(values: DataFrame, col: str, by: Sequence[str] = (), salts: int = 16) -> DataFrame:
    """Add ``_bucket``: which of 1024 roughly equal ranges of ``col`` (per group) the value lies in.

    The range edges come from a mergeable sketch of bounded size; groups are salted, so a group that
    holds most values is still spread over many tasks. Equal values share a bucket.
    """
    by = list(by)
    marks = [i / BUCKETS for i in range(1, BUCKETS)]
    edges = values.groupBy(*by).agg(F.percentile_approx(col, marks, 4 * BUCKETS).alias("_edges"))
    edges = edges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = values.withColumn("_salt", F.pmod(F.xxhash64(col), F.lit(salts)).cast("int"))
    out = salted.join(edges, [*by, "_salt"]).withColumn("_bucket", F.lit(0))
    # Bisection over the 1023 edges, one comparison per step; the result counts the edges below the value.
    step = BUCKETS // 2
    while step:
        below = F.get("_edges", F.col("_bucket") + (step - 1)) < F.col(col)
        out = out.withColumn("_bucket", F.col("_bucket") + F.when(below, step).otherwise(0))
        step //= 2
    return out.select(*values.columns, "_bucket")


#: Bits that one pass over the candidates settles, and what the first pass leaves open: at most 2^49 doubles lie in one range.
DIGIT, PASSES = 16, 3


def sortable(x: Column) -> Column:
    """The bits of a double as a long that sorts like the double; NaN comes last, both zeros are one."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(x, F.lit(0.0)) + F.lit(0.0)).cast("long")
    return F.when(x.isNotNull(), bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit(2 ** 63 - 1))))


def leading(x: Column) -> Column:
    """Sign, exponent and a sixteenth of it as one number that grows with ``x``: the leading digit, without taking bits."""
    size = F.least(16 * (F.log2(F.abs(x)) + 1100), F.lit(100_000.0))  # doubles reach from 2^-1074 to 2^1024
    return (F.when(F.isnan(x), F.lit(200_000.0)).when(x > 0, F.floor(size)).when(x < 0, F.floor(-size)).otherwise(F.lit(0.0))).cast("long")


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = (), salts: int = 16) -> DataFrame:
    """Linearly interpolated quantiles of many columns at once, exact: ``by, column, p, q``.

    Radix selection. The first scan counts leading digits and picks, per column and quantile, the one that holds the
    wanted rank. The second keeps the values with that digit, ties as one. Three passes over these candidates
    settle the remaining bits, sixteen at a time: counts per digit, then only the wanted digit. Two scans of the
    rows whatever the size; counts per group, column and task are bounded by the digits there are, and no more
    than 2^17 are ever sorted per group. Nulls are left out; null groups are groups. Rows are salted where they meet the picks.
    """
    by, cols = list(by), list(cols)
    if by and by != [SERIES]:
        return unpack(column_quantiles(pack(df.select(*by, *cols), by), cols, qs, [SERIES], salts), by)
    values = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(cols)]))).where("_x IS NOT NULL")
    keys = [*by, "_c"]
    every = Window.partitionBy(*keys)
    top = values.groupBy(*keys, leading(F.col("_x")).alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    top = top.withColumn("_all", F.sum("_n").over(every)).withColumn("p", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    top = top.withColumn("_want", F.col("p") * (F.col("_all") - 1)).withColumns({
        "_frac": F.col("_want") - F.floor("_want"), "_rank": F.floor("_want"), "_after": F.lit(None).cast("double")})
    rank = [*keys, "p", "_frac", "_rank", "_after"]

    def salted(state: DataFrame) -> DataFrame:
        return state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    picked = _picked(top, keys).select(*rank, F.col("_min").alias("_lo"), F.col("_max").alias("_hi"))
    met = values.withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(salts)).cast("int")).join(salted(picked), [*keys, "_salt"])
    held = met.where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))).groupBy(*rank, "_lo", "_x").agg(F.count(F.lit(1)).alias("_n"))
    # how far above the least value of the range, in steps of the last bit
    now = held.withColumn("_off", sortable(F.col("_x")) - sortable(F.col("_lo"))).withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(salts)).cast("int"))
    for k in range(PASSES - 1, -1, -1):
        mine = now
        if k < PASSES - 1:
            mine = now.drop("_frac", "_rank", "_after").withColumn("_d", F.shiftright("_off", DIGIT * (k + 1)))
            mine = mine.join(salted(last.select(*rank, "_d")), [*keys, "p", "_d", "_salt"]).drop("_d")
        counts = mine.groupBy(*rank, F.shiftright("_off", DIGIT * k).alias("_d")).agg(
            F.sum("_n").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
        last = _picked(counts, keys)
    # the last digit leaves one value; its neighbour is itself while the digit holds the next rank too
    next_ = F.when(F.col("_rank") + 1 < F.col("_n"), F.col("_min")).otherwise(F.coalesce("_after", "_min"))
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_c") + 1)
    between = F.when(F.col("_frac") == 0, F.col("_min")).otherwise(F.col("_min") + (next_ - F.col("_min")) * F.col("_frac"))
    return last.select(*by, names.alias("column"), "p", between.alias("q"))


def _picked(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and ``p`` the digit that holds rank ``_rank``, the rank inside it, and the least value behind it (``_after``)."""
    ordered = Window.partitionBy(*keys, "p").orderBy("_d")
    run = counts.withColumns({
        "_before": F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_next": F.coalesce(F.lead("_min").over(ordered), F.col("_after"))})
    hit = run.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    return hit.select(*keys, "p", "_d", "_n", "_min", "_max", "_frac", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_next").alias("_after"))


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``column_quantiles`` of one column: ``by, p, q``."""
    return column_quantiles(df, [col], qs, by).drop("column")
