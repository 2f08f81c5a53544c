"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.llm.common import discard, stage


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour (itself included)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
    return (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_m"))
    moved = down.join(least, "a").where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.union(least.select("a", F.col("_m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``links`` with columns ``a``, ``b``.

    Both hold longs. Self links and repeated links are harmless; nodes without a link to another do not
    come out. Each round is a few joins over the links, staged so that lost executors cost no more than
    the round; a hub is joined, never collected. Rounds grow with the logarithm of the longest chain.
    """
    now = stage(links.select("a", "b").where("a <> b").distinct(), label)
    before = _state(now)
    while before[0]:
        new = stage(_small_star(_large_star(now)), label)
        after = _state(new)
        discard(now)
        now = new
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
