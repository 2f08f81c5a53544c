"""SimHash near-duplicates through segment signatures with one wildcard bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sensorweave.llm.common import discard, free_name, stage
from sensorweave.llm.components import components

SEED = 42
BITS = 64
#: Shingles whose hashes are held at once, so that a text of any length needs bounded memory.
BLOCK = 65_536
#: Signatures with more members than this are linked by shared neighbours in place of pairs.
CROWD = 32
#: Signatures of three members and more are broadcast up to this many (16 bytes each); Spark joins beyond it.
BROADCAST_SIGNATURES = 500_000


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Every run of ``size`` words, space-joined; the whole sequence if it is shorter."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]


def fingerprint(text: bytes | None, size: int) -> int:
    """64-bit SimHash of a UTF-8 text, A-Z lowered; 0 for a text without words."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and the six ASCII spaces only
    total = max(len(words) - size + 1, 1) if words else 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, BLOCK):
        part = shingles(words[at:at + BLOCK + size - 1], size)
        hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in part), "<u8", len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", size: int = 3) -> DataFrame:
    """The columns of ``df`` but the text, and ``out``: the fingerprint as a long."""
    rest = [c for c in df.columns if c != text]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").cast("binary").alias("_bytes"))
    schema = rows.drop("_bytes").withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), size) for t in b.column("_bytes")], pa.int64())
            kept = [b.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, fps], names=[*rest, out])

    return rows.mapInArrow(run, schema)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _signatures(fps: DataFrame, bits: int) -> DataFrame:
    """One row per fingerprint, segment and wildcard: ``key`` names segment, wildcard bit and the other bits.

    ``segment`` halves of ``bits`` bits: of two fingerprints two bits apart, at least one half differs in
    one bit or none, so the pair shares that half's signature with the wildcard on the bit.
    """
    segments = BITS // bits
    part = F.expr(f"shiftrightunsigned(fp, cast(_s * {bits} as int)) & {(1 << bits) - 1}L")
    hole = F.expr("~shiftleft(1L, cast(_w as int))")
    spread = (fps.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
              .withColumn("_part", part).withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))))
    key = F.expr(f"shiftleft(cast(_s * {bits} + _w as long), {bits})").bitwiseOR(F.col("_part").bitwiseAND(hole))
    return spread.select(key.alias("key"), "fp")


def links(fps: DataFrame, label: str = "simhash") -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) at most two bits apart.

    Not every close pair comes out, but any two close fingerprints are joined by a chain of links, and
    every link is verified: components are exact. Signatures with two members, the common case, are
    settled by their minimum and maximum; up to ``CROWD`` members meet in an equality join on the
    signature. Fingerprints in a larger signature emit the 65 values at most one bit away: two of them
    are at most two bits apart exactly when they share such a value, so each value links its members
    to the smallest, one row per member and no pairs.
    """
    keyed = _signatures(fps, BITS // 2)
    buckets = stage(keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), label)
    near = distance(F.col("a"), F.col("b")) <= 2
    twos = buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).where(near)

    more = buckets.where("n > 2").select("key", "n")
    small = F.broadcast if more.count() <= BROADCAST_SIGNATURES else (lambda x: x)
    several = stage(keyed.join(small(more), "key"), label)
    few = several.where(F.col("n") <= CROWD)
    pairs = (few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
             .where((F.col("a") < F.col("b")) & near).select("a", "b"))

    crowded = several.where(F.col("n") > CROWD).select("fp").distinct()
    ball = F.concat(F.array(F.lit(0).cast("long")), F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = stage(crowded.select("fp", F.explode(ball).alias("_flip"))
                   .select("fp", F.col("fp").bitwiseXOR(F.col("_flip")).alias("value")), label)
    centres = around.groupBy("value").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = around.join(centres, "value").select(F.col("fp").alias("a"), "b").where((F.col("a") != F.col("b")) & near)
    return twos.union(pairs).union(stars).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` of every row.

    Rows whose fingerprints differ in at most two bits are linked; ``component_id`` is the smallest key
    reachable. Texts without words have fingerprint 0 and are linked like any other. Nulls: a null text
    has no words, a null key is no candidate for the smallest (a component of null keys has a null id).
    Repeated rows come out as often as they went in.
    """
    name = "key"
    fps = stage(with_fingerprint(df.select(F.col(f"`{key}`").alias(name), F.col(f"`{text}`").alias("text")),
                                 "text", "fp", size), "simhash-fps")
    distinct = stage(fps.groupBy("fp").agg(F.min(name).alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp")), "simhash-components")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stage(rooted.join(ids, "root").select("fp", "component_id"), "simhash-classes")
    return fps.join(classes, "fp").select(F.col(name).alias(key), "fp", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """The row with the smallest key of every component of ``near_duplicates``, with the columns it came with.

    A null key gives way to any other. Of rows that share the smallest key the first one written stays.
    Texts without words are alike; an empty table stays empty. Lists of places alone are shuffled and
    grouped, so a component of a third of all rows costs one partial aggregate per task.
    """
    row = free_name(df, "_row")
    tagged = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row),
                       F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    # the place of a row is fixed by writing it
    rows = stage(tagged.withColumn("_place", F.monotonically_increasing_id()), "simhash-rows")
    groups = near_duplicates(rows, "_place", "_text", size).select("_place", "component_id")
    order = F.struct(F.col("_key").isNull(), "_key", "_place")
    chosen = rows.select("_place", "_key").join(groups, "_place").groupBy("component_id").agg(F.min(order).alias("_best"))
    return rows.join(chosen.select(F.col("_best._place").alias("_place")), "_place", "left_semi").select(f"{row}.*")
