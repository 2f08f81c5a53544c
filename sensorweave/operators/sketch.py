"""A Bloom filter as a table of bit maps: built by partial aggregates, merged by shuffles of fixed size, asked in joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash functions of the filter.
SEEDS = (0, 1)
_BUCKET = 1 << 15  # bits of one map


def _places(values: Sequence[Column], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(s), *values), F.lit(1 << bits)) + 1 for s in SEEDS]


def common_types(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """The types in which columns of both tables compare."""
    both = a.select(*cols).limit(0).unionByName(b.select(*cols).limit(0))
    return {f.name: f.dataType.simpleString() for f in both.schema.fields}


def bit_sketch(df: DataFrame, values: Sequence[Column], bits: int = 24) -> DataFrame:
    """``bucket`` and ``bitmap``: a filter of ``2 ** bits`` bits, whatever the rows, over the tuples of ``values``.

    Null values count as values. Zeros of either sign are one value, as in a join.
    """
    if bits < 15:
        raise ValueError("a sketch has at least 2 ** 15 bits")
    place = df.select(F.explode(F.array(*_places(values, bits))).alias("at"))
    return place.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def with_maybe(df: DataFrame, sketch: DataFrame, values: Sequence[Column], bits: int = 24, out: str = "_maybe") -> DataFrame:
    """Add whether the sketched rows may hold the tuple of ``values``: never false for one that they hold.

    The sketch goes to all tasks: ``2 ** bits / 8`` bytes at most. The rows stay where they are.
    """
    maybe = F.lit(True)
    for i, place in enumerate(_places(values, bits)):
        side = F.broadcast(sketch.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bitmap").alias(f"_bitmap{i}")))
        at = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring(F.col(f"_bitmap{i}"), F.expr("cast(1 as int)") + F.floor(at / 8).cast("int"), F.lit(1))), 16, 10)
        hit = F.coalesce(F.getbit(byte.cast("int"), (at % 8).cast("int")) == 1, F.lit(False))
        df = df.join(side, F.bitmap_bucket_number(place) == F.col(f"_bucket{i}"), "left")
        maybe = maybe & hit
    drop = [f"_{n}{i}" for i in range(len(SEEDS)) for n in ("bucket", "bitmap")]
    return df.withColumn(out, maybe).drop(*drop)
