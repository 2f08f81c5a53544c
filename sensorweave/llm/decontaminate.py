"""Benchmark decontamination over template windows: numbers, names and units become typed slots."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from sensorweave.llm.common import free_name, stage

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£°]")
#: The first letter of a text, a line, or a sentence: a capital there says nothing about a name.
OPENING = re.compile(r"(?:^|[.!?:\n])[\s\"'(\[]*([^\W\d_])")
#: Unit words and signs, in lower case.
UNITS = frozenset("""% $ € £ ° mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms
ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours
day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees meter meters metre
metres kilometer kilometers kilometre kilometres""".split())
SLOTS = {"<number>": 1, "<name>": 2, "<unit>": 3}
MIX = np.uint64(0x9E3779B97F4A7C15)
SEED = 17
BLOCK = 1 << 16
BITS = 20
#: Leading bits of a hash that a packed table knows: 16 MB.
TABLE = 27


@dataclass(frozen=True)
class Params:
    """``window`` tokens a window has, at least ``literals`` of them no slots where slots may differ; a document is a
    hit of an item when matched windows in near alignments cover ``share`` of the item's tokens. Items of fewer than
    ``least`` tokens are not searched for: ordinary texts hold them by chance (``unsearchable`` lists them)."""

    window: int = 8
    least: int = 4
    literals: int = 5
    share: float = 0.5
    #: Item windows whose hashes go along with the tasks to drop other windows early, 8 bytes each. Of more windows a bit
    #: table of fixed size goes along, which lets some others through to the join.
    filter_windows: int = 1_000_000


class _Canon(dict):
    """Token to 64-bit template code, remembered for up to ``limit`` different tokens."""

    limit = 200_000

    @staticmethod
    def literal(token: str) -> int:
        return xxh64_intdigest(token.lower(), SEED) | 8

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first.isdigit():
            code = SLOTS["<number>"]
        elif token.lower() in UNITS:
            code = SLOTS["<unit>"]
        elif first.isupper() and len(token) > 1:
            code = SLOTS["<name>"]
        else:
            code = self.literal(token)
        if len(self) >= self.limit:
            self.clear()
        self[token] = code
        return code


def tokens_of(text: str) -> list[str]:
    """Tokens, with the opening letter of sentences lowered so that only capitals inside one mark a name."""
    return TOKEN.findall(OPENING.sub(lambda m: m[0][:-1] + m[1].lower(), text))


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` codes."""
    n = len(codes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for i in range(size):
            out = (out ^ codes[i:i + n]) * MIX
            out ^= out >> np.uint64(29)
    return out


def with_bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and a table of their leading bits, for ``held``."""
    bits = np.zeros(1 << BITS, bool)
    bits[(hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return hashes, bits


def held(wanted: tuple[np.ndarray, np.ndarray] | np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is a wanted one; most are settled by the table. A packed table alone may say yes by chance."""
    if isinstance(wanted, np.ndarray):
        place = hashes >> np.uint64(64 - TABLE)
        return (wanted[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    known, bits = wanted
    out = bits[(hashes >> np.uint64(64 - BITS)).astype(np.int64)]
    near = np.flatnonzero(out)
    if len(near):
        spot = np.minimum(np.searchsorted(known, hashes[near]), len(known) - 1)
        out[near] = known[spot] == hashes[near]
    return out


def packed_table(index: DataFrame) -> np.ndarray:
    """The leading ``TABLE`` bits of the index's hashes as a bit table, made by tasks: ``2 ** TABLE / 8`` bytes, whatever
    the index."""
    words = index.select(F.expr(f"shiftrightunsigned(hash, {64 - TABLE})").alias("at")).groupBy(
        F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (TABLE - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def windows_of(tokens: list[str], p: Params, canon: _Canon, size: int,
               wanted: tuple[np.ndarray, np.ndarray] | np.ndarray | None = None):
    """Positions, hashes and slot values of the windows, in blocks; only ``wanted`` hashes if given.

    Each window comes out by its words in lower case, without slots, and once more by its template if it
    has slots and enough literals.
    """
    for at in range(0, max(len(tokens) - size + 1, 0), BLOCK):
        part = tokens[at:at + BLOCK + size - 1]
        codes = np.fromiter(map(canon.__getitem__, part), np.uint64, len(part))
        hashes = window_hashes(codes, size)
        slots = np.concatenate([[0], np.cumsum(codes < 8)])
        typed = np.flatnonzero(codes < 8)
        exact = hashes
        if len(typed):
            literal = codes.copy()
            literal[typed] = np.fromiter((canon.literal(part[j]) for j in typed), np.uint64, len(typed))
            exact = window_hashes(literal, size)
        n_slots = slots[size:] - slots[:-size]
        fits = (n_slots > 0) & (n_slots <= max(size - p.literals, 0))
        if wanted is not None:
            fits &= held(wanted, hashes)
        plain = np.flatnonzero(held(wanted, exact)) if wanted is not None else np.arange(len(exact))
        typed_at = np.flatnonzero(fits)
        values = [[part[j].lower() for j in range(i, i + size) if codes[j] < 8] for i in typed_at]
        yield (at + np.concatenate([plain, typed_at])).astype(np.int32), np.concatenate([exact[plain], hashes[typed_at]]), len(plain), values


_WINDOW = "pos int, hash long, slots array<string>, size int, n_tokens int"


def _windows(df: DataFrame, key: str, text: str, p: Params, sizes: tuple[int, ...], whole_short: bool,
             wanted: dict[int, np.ndarray] | np.ndarray | None) -> DataFrame:
    """``key`` and the windows of each text. Texts shorter than the window are one window if ``whole_short``.

    ``wanted``: the sorted hashes of each size, or a packed table for all; none lets every window through.
    """
    rows = df.select(F.col(key), F.col(f"`{text}`").cast("string").alias("_text"))
    schema = StructType([rows.schema[key], *StructType.fromDDL(_WINDOW).fields])
    shared = df.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = _Canon()
        known = {}
        if shared is not None:
            packed = isinstance(shared.value, np.ndarray)
            known = dict.fromkeys(sizes, shared.value) if packed else {size: with_bits(hashes) for size, hashes in shared.value.items()}
        for b in batches:
            held_back: list[tuple] = []
            n_held = 0

            def made(b=b) -> pa.RecordBatch:
                owner, pos, hashes, lengths, flat, size, n = zip(*held_back)
                count = [len(x) for x in pos]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)),
                                                 pa.array([v for f in flat for x in f for v in x], pa.string()))
                return pa.RecordBatch.from_arrays([
                    b.column(key).take(pa.array(np.repeat(owner, count))), pa.array(np.concatenate(pos)), pa.array(np.concatenate(hashes).view(np.int64)),
                    lists, pa.array(np.repeat(size, count).astype(np.int32)), pa.array(np.repeat(n, count).astype(np.int32))],
                    names=[key, "pos", "hash", "slots", "size", "n_tokens"])

            for row, value in enumerate(b.column("_text")):
                tokens = tokens_of(value.as_py() or "")
                n = len(tokens)
                own = sizes
                if whole_short:
                    own = (min(n, p.window),) if n >= p.least else ()
                for size in own:
                    for pos, hashes, plain, values in windows_of(tokens, p, canon, size, known.get(size)):
                        if len(pos):
                            lengths = np.concatenate([np.zeros(plain, np.int64), np.array([len(v) for v in values], np.int64)])
                            held_back.append((row, pos, hashes, lengths, values, size, n))
                            n_held += len(pos)
                    if n_held > BLOCK:
                        yield made()
                        held_back, n_held = [], 0
            if held_back:
                yield made()

    return rows.mapInArrow(run, schema)


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
            item_text: str = "text", p: Params = Params()) -> DataFrame:
    """One row per document and item it holds: ``key``, ``item``, ``n_windows``, ``share``, ``kind``.

    Windows meet by an equality join on the hash of their words in lower case, or of their template. Matched
    windows of one alignment (document position less item position) must agree in their slots: an item's
    value stands for one value of the document throughout; where it does not, only windows that repeat the
    item's own words count. ``share`` is the part of the item's tokens that the agreeing windows of near
    alignments cover, which inserted and dropped words shift against each other; alignments half the
    item's length apart always count together. ``kind`` is ``exact`` where all words are the item's own, else ``template``.
    Items of fewer tokens than a window, but ``p.least`` or more, are matched whole. Null and empty texts have no windows, rows with
    a null key come out with a null key; documents that repeat a key count as one; an empty table gives
    no rows. Only matched windows are shuffled; the item side is broadcast while it is small to Spark.
    """
    if item.lower() == key.lower():
        raise ValueError(f"documents and items both call their key {key!r}: rename one, both come out")
    given = items.select(F.col(f"`{item}`").alias("_item"), F.col(f"`{item_text}`").alias("_body"))
    index = stage(_windows(given, "_item", "_body", p, (), True, None), "decontaminate-index")
    sizes = tuple(sorted(r[0] for r in index.select("size").distinct().collect()))  # at most ``window`` values
    if not sizes:
        sizes = (p.window,)
    n = index.count()
    if n > p.filter_windows:
        wanted = packed_table(index)
    else:
        got = index.select("size", "hash").distinct().toPandas()
        wanted = {s: np.sort(got["hash"][got["size"] == s].to_numpy(np.int64).view(np.uint64)) for s in sizes}
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_body"))
    found = _windows(rows, "_key", "_body", p, sizes, False, wanted).drop("n_tokens")
    left = found.withColumnsRenamed({"pos": "_at", "slots": "_values"})
    hits = left.join(index, ["size", "hash"]).where(F.size("slots") == F.size("_values"))
    hits = hits.withColumn("_shift", F.col("_at") - F.col("pos"))
    bound = F.transform(F.arrays_zip("slots", "_values"), lambda x: F.struct(x["slots"].alias("a"), x["_values"].alias("b")))
    same = F.col("slots") == F.col("_values")
    aligned = hits.groupBy("_key", "_item", "_shift", "size", "n_tokens").agg(
        F.sort_array(F.collect_set("pos")).alias("_all"),  # at most the item's tokens
        F.sort_array(F.collect_set(F.when(same, F.col("pos")))).alias("_same"),
        F.array_distinct(F.flatten(F.collect_set(bound))).alias("_bound"))
    one_value = F.size(F.array_distinct(F.transform("_bound", lambda x: x["a"]))) == F.size("_bound")
    aligned = aligned.withColumn("_pos", F.when(one_value, F.col("_all")).otherwise(F.col("_same")))
    # each alignment by itself, and in two overlapping grids with the near ones
    width = F.col("n_tokens") + p.window
    cell = lambda grid, at: F.struct(F.lit(grid).alias("grid"), at.cast("long").alias("at"))
    cells = F.array(cell(0, F.col("_shift")), cell(1, F.floor(F.col("_shift") / width)), cell(2, F.floor(F.col("_shift") / width + 0.5)))
    joint = aligned.where(F.size("_pos") > 0).withColumn("_bound", F.when(one_value, F.col("_bound")).otherwise(F.slice("_bound", 1, 0)))
    joint = joint.withColumn("_cell", F.explode(cells)).groupBy("_key", "_item", "_cell", "size", "n_tokens").agg(
        *[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("_pos", "_same")],
        F.array_distinct(F.flatten(F.collect_list("_bound"))).alias("_bound"))
    joint = joint.withColumn("_pos", F.when(one_value, F.col("_pos")).otherwise(F.col("_same")))
    cover = F.aggregate(
        F.transform("_pos", lambda x, i: F.least(F.col("size"), F.coalesce(F.get("_pos", i + 1) - x, F.col("size")))),
        F.lit(0), lambda a, x: a + x)
    scored = joint.where(F.size("_pos") > 0).select(
        "_key", "_item", F.struct((cover / F.col("n_tokens")).alias("share"),
                                  (F.col("_pos") == F.col("_same")).alias("exact"),
                                  F.size("_pos").cast("long").alias("n")).alias("_s"))
    best = scored.groupBy("_key", "_item").agg(F.max("_s").alias("_s")).where(F.col("_s.share") >= p.share)
    return best.select(F.col("_key").alias(key), F.col("_item").alias(item), F.col("_s.n").alias("n_windows"),
                       F.col("_s.share").alias("share"),
                       F.when(F.col("_s.exact"), F.lit("exact")).otherwise(F.lit("template")).alias("kind"))


def unsearchable(items: DataFrame, item: str = "item_id", item_text: str = "text", p: Params = Params()) -> DataFrame:
    """``item`` and ``n_tokens`` of the items that are too short to look for; null and empty texts are among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(tokens_of(t.as_py() or "")) for t in b.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(item), n], names=[item, "n_tokens"])

    rows = items.select(F.col(f"`{item}`"), F.col(f"`{item_text}`").cast("string").alias("_text"))
    schema = StructType([rows.schema[item], *StructType.fromDDL("n_tokens long").fields])
    return rows.mapInArrow(run, schema).where(F.col("n_tokens") < p.least)


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with the columns they came with.

    Rows that repeat a key, and rows with a null key, are judged by their own text: the place of a row,
    fixed by writing it, stands for the key.
    """
    row = free_name(docs, "_row")
    whole: Column = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stage(docs.select(whole.alias(row), F.col(f"`{text}`").alias("_text"))
                 .withColumn("_place", F.monotonically_increasing_id()), "decontaminate-rows")
    bad = matches(rows.select("_place", "_text"), items, "_place", "_text", **options).select("_place").distinct()
    return rows.join(bad, "_place", "left_anti").select(f"{row}.*")
