"""Contiguous shards of equal bytes, from prefix sums over range partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorweave.llm.common import stage

#: The totals are joined as a broadcast up to this many rows; Spark chooses beyond it.
BROADCAST_ROWS = 100_000


def by_bytes(df: DataFrame, order: Sequence[str], size: Column, n_shards: int, carry: Sequence[str] = ()) -> DataFrame:
    """``order`` and ``carry`` columns of every row, with ``size``, ``shard`` and ``slot``.

    Rows stand in the sequence of ``order`` (nulls first, ties in any order: such rows are alike). A row
    goes where the middle of its bytes falls when all bytes are cut into ``n_shards`` equal parts, so a
    shard is off the target by at most half of its first and last row. ``slot`` counts from 0 in a shard.

    The sequence is range-partitioned, also over rows with equal ``order``, and staged with the number of
    its partition. One total per partition gives every partition its global start; only those totals
    (one row per partition and shard) pass a single task. Needs a size of 0 or more; a null size is 0.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    rows = df.select(*[F.col(f"`{c}`") for c in (*order, *carry)], F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    spread = rows.repartitionByRange(*[F.col(f"`{c}`").asc_nulls_first() for c in order], F.col("_tie"))
    parts = stage(spread.withColumn("_part", F.spark_partition_id()), "shard-parts")

    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = F.broadcast if n_parts + n_shards <= BROADCAST_ROWS else (lambda x: x)

    totals = parts.groupBy("_part").agg(F.sum("size").alias("_bytes"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"))
    whole = parts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    inside = Window.partitionBy("_part").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order], "_tie")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = parts.withColumn("_upto", upto).join(small(starts), "_part")
    twice = 2 * (F.col("_start") + F.col("_upto")) - F.col("size")
    # decimal: the product passes a long beyond a few exabytes
    shard = F.floor(twice.cast("decimal(38,0)") * n_shards / (2 * whole)) if whole else F.lit(0)
    placed = placed.withColumn("shard", F.least(shard, F.lit(n_shards - 1)).cast("int"))
    placed = placed.withColumn("_row", F.row_number().over(
        Window.partitionBy("_part", "shard").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order], "_tie")))
    placed = stage(placed, "shard-placed")

    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return (placed.join(small(offsets), ["shard", "_part"])
            .withColumn("slot", (F.col("_offset") + F.col("_row") - 1).cast("long"))
            .select(*[F.col(f"`{c}`") for c in (*order, *carry)], "size", "shard", "slot"))
