"""Repeated byte strings over all documents, by a radix sort of suffixes no deeper than the threshold.

A suffix matters only through its first ``length`` bytes, its window. Windows that start next to each
other choose the same sample byte string (the one with the smallest hash in the window), so the sort
carries one row per run of such windows. Most-significant-digit passes follow, each over the survivors of
the one before:

1. the sample string itself: a run whose sample occurs once holds no repeated window;
2. all bytes the run's windows cover: runs that agree here repeat window for window, and only the first
   of each such group goes on, if another group shares its sample;
3. the bytes that blocks of eight neighbouring windows (by their offset to the sample) have in common: a
   block whose common bytes occur once holds no repeated window;
4. all bytes the block's windows cover, as in pass 2;
5. single windows at full depth: the places where a repeat starts or ends.

Equal windows choose equal samples at equal offsets, so they always meet; groups that stay equal through
the last pass are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from sensorweave.llm.common import discard, stage

LENGTH = 100
SAMPLE = 32
#: Windows of a text that are hashed at once.
BLOCK = 1 << 18
_AT_BITS = 20
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


class Sampler:
    """Splits a text's windows into runs that share their sample string."""

    def __init__(self, length: int = LENGTH, sample: int | None = None):
        self.length, self.sample = length, min(sample or SAMPLE, max(1, length // 3))
        n = BLOCK + length
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def _samples(self, raw: np.ndarray) -> np.ndarray:
        """Mixed hash of each run of ``sample`` bytes, from prefix sums of a polynomial."""
        k = self.sample
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * self.down[:len(raw)], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.up[:len(raw) - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return h

    def runs(self, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Starts, windows, sample hashes and samples' offsets in the first window of all runs, in order and
        block by block, for a text of at least ``length`` bytes."""
        last = len(data) - self.length + 1
        for at in range(0, last, BLOCK):
            n = min(BLOCK, last - at)
            raw = np.frombuffer(data, np.uint8, n + self.length - 1, at)
            hashes = self._samples(raw)
            # smallest hash of the window, the leftmost of equals: place in the low bits
            least = (hashes >> np.uint64(_AT_BITS) << np.uint64(_AT_BITS)) | np.arange(len(hashes), dtype=np.uint64)
            width, have = self.length - self.sample + 1, 1
            while have < width:
                step = min(have, width - have)
                least = np.minimum(least[:len(least) - step], least[step:])
                have += step
            place = (least & np.uint64((1 << _AT_BITS) - 1)).astype(np.int64)[:n]
            cuts = np.flatnonzero(np.diff(place)) + 1
            starts = np.concatenate([[0], cuts])
            ends = np.concatenate([cuts, [n]])
            spots = place[starts]
            yield at + starts, ends - starts, hashes[spots].view(np.int64), spots - starts


_RUN = [("h", pa.int64()), ("c", pa.int64()), ("p", pa.int64()), ("n", pa.int32()), ("o", pa.int32())]
#: Neighbouring windows that pass 3 tests together.
STEP = 8


def _runs(rows: DataFrame, length: int) -> DataFrame:
    """``doc``, ``tie`` and every run: sample hash ``h``, hash of the run's bytes ``c``, start ``p``, windows ``n``, offset ``o``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(length)
        for b in batches:
            owner, cols = [np.zeros(0, np.int64)], [[np.zeros(0, np.int64)] for _ in _RUN]
            for i, value in enumerate(b.column("data")):
                data = value.as_py() or b""
                if len(data) < length:
                    continue
                for start, windows, code, offset in sampler.runs(data):
                    ends = start + windows + (length - 1)
                    whole = np.fromiter((xxh3_64_intdigest(data[x:y]) for x, y in zip(start.tolist(), ends.tolist())),
                                        np.uint64, len(start))
                    owner.append(np.full(len(start), i))
                    for col, part in zip(cols, (code, whole.view(np.int64), start, windows, offset)):
                        col.append(part)
            own = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(own), b.column("tie").take(own),
                 *[pa.array(np.concatenate(v)).cast(t) for v, (_, t) in zip(cols, _RUN)]], names=["doc", "tie", *[x for x, _ in _RUN]])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, tie long, h long, c long, p long, n int, o int")


def _samples(rows: DataFrame, length: int) -> DataFrame:
    """The sample hashes ``h`` of all runs, alone: what the first pass counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(length)
        for b in batches:
            codes = [np.zeros(0, np.int64)]
            for value in b.column("data"):
                data = value.as_py() or b""
                if len(data) >= length:
                    codes += [code for _, _, code, _ in sampler.runs(data)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes))], names=["h"])

    return rows.select("data").mapInArrow(run, "h long")


def blocks_of(data: bytes, start: int, windows: int, offset: int, length: int) -> Iterator[tuple[int, ...]]:
    """A run's blocks: number, hash of the bytes common to its windows, start, windows, offset, hash of all its bytes.

    A block is the windows with sample offsets from ``STEP * j`` to ``STEP * j + STEP - 1``; a run may own a part.
    """
    i = 0
    while i < windows:
        at = offset - i
        j = at // STEP
        n = min(windows - i, at - STEP * j + 1)
        sample = start + offset
        core = data[sample - STEP * j:sample - STEP * j - STEP + 1 + length]
        hull = data[start + i:start + i + n - 1 + length]
        yield j, xxh3_64_intdigest(core) - (1 << 63), start + i, n, at, xxh3_64_intdigest(hull) - (1 << 63)
        i += n


_BLOCK = [("h", pa.int64()), ("j", pa.int32()), ("core", pa.int64()), ("p", pa.int64()), ("n", pa.int32()),
          ("o", pa.int32()), ("c", pa.int64())]


def _blocks(rows: DataFrame, length: int) -> DataFrame:
    """The blocks of the listed runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, made = [], []
            for i in range(b.num_rows):
                data = b.column("data")[i].as_py() or b""
                for r in b.column("_runs")[i].as_py():
                    for x in blocks_of(data, r["p"], r["n"], r["o"], length):
                        owner.append(i)
                        made.append((r["h"], *x))
            own = pa.array(owner, pa.int32())
            cols = list(zip(*made)) if made else [[]] * len(_BLOCK)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(own), b.column("tie").take(own), *[pa.array(v, t) for v, (_, t) in zip(cols, _BLOCK)]],
                names=["doc", "tie", *[x for x, _ in _BLOCK]])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, tie long, h long, j int, core long, "
                                "p long, n int, o int, c long")


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """One row per window of the listed runs: its 128-bit hash ``w`` and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data, at = b.column("data")[i].as_py() or b"", []
                for r in b.column("_runs")[i].as_py():
                    at += range(r["p"], r["p"] + r["n"])
                for k in range(0, len(at), BLOCK):
                    part = at[k:k + BLOCK]
                    own = pa.array([i] * len(part), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc").take(own), b.column("tie").take(own),
                         pa.array([xxh3_128_digest(data[p:p + length]) for p in part], pa.binary()),
                         pa.array(part, pa.int64())], names=["doc", "tie", "w", "p"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, tie long, w binary, p long")


def _place(*extra: str) -> Column:
    return F.struct("doc", "tie", "p", *extra)


def repeated_ranges(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Byte ranges ``a`` .. ``b`` (exclusive) of ``doc``, ``tie`` that windows with an earlier equal cover.

    ``rows`` has ``doc``, ``tie`` (both order the documents) and ``data`` (binary). Ranges may overlap.
    """
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc", "tie")]

    def texts(listed: DataFrame, *cols: str) -> DataFrame:
        """The texts that the listed runs are in, with their runs (at most one per byte of the text)."""
        per = listed.groupBy("doc", "tie").agg(F.collect_list(F.struct(*cols)).alias("_runs"))
        return rows.alias("l").join(per.alias("r"), same[0] & same[1]).select("l.doc", "l.tie", "data", "_runs")

    def split(digits: DataFrame, found: DataFrame, digit: list[str], whole: list[str], label: str) -> tuple[DataFrame, DataFrame]:
        """Two passes: rows whose ``digit`` occurs again (``digits`` has those of all rows), then ``whole`` among
        them. Gives the ranges of all but the first of each group, and the firsts of groups that share their
        digit with another group."""
        again = stage(digits.groupBy(*digit).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k"), f"{label}-digit")
        left = stage(found.join(again, digit), f"{label}-left")
        key = [*digit, *whole]
        groups = stage(left.groupBy(*key).agg(F.min(_place("o")).alias("first"), F.count(F.lit(1)).alias("_k"),
                                              F.max("n").alias("_n")), f"{label}-groups")
        later = (left.join(groups.where("_k > 1").select(*key, "first"), key)
                 .where(_place("o") != F.col("first")).select("doc", "tie", F.col("p").alias("a"), (F.col("p") + F.col("n") + length - 1).alias("b")))
        later = stage(later, f"{label}-ranges")
        discard(left)
        mixed = groups.groupBy(*digit).agg(F.count(F.lit(1)).alias("_g")).where("_g > 1").drop("_g")
        return later, groups.join(mixed, digit).select("first.*", F.col("_n").alias("n"), "h")

    copies, edges = split(_samples(rows, length), _runs(rows, length), ["h"], ["c"], "substrings-runs")
    found = stage(_blocks(texts(edges, "p", "n", "o", "h"), length), "substrings-blocks")
    more, ends = split(found, found, ["h", "j", "core"], ["o", "n", "c"], "substrings-blocks")
    discard(found)
    windows = stage(_windows(texts(ends, "p", "n"), length), "substrings-windows")
    first = windows.groupBy("w").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
    single = windows.join(first.select("w", "first"), "w").where(_place() != F.col("first"))
    return copies.union(more).union(single.select("doc", "tie", F.col("p").alias("a"), (F.col("p") + length).alias("b")))


def cut(data: bytes, ranges: list[dict]) -> tuple[list[bytes], int, int]:
    """Kept pieces, removed bytes and maximal removed runs."""
    kept, at, removed, spans = [], 0, 0, 0
    end = -1
    for r in sorted((r["a"], r["b"]) for r in ranges):
        a, b = r
        if a > end:
            kept.append(data[at:a])
            spans += 1
            removed += b - a
        elif b > end:
            removed += b - end
        end = max(end, b)
        at = end
    kept.append(data[at:])
    return kept, removed, spans


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary) and ``kept_sha256`` of every row.

    Each byte of the UTF-8 text (null: empty) goes that lies in a window of ``length`` bytes which also
    starts earlier: in a document with a smaller key, or earlier in the same one. A null key is smaller
    than any other. Rows that share a key are ordered by the XXH64 of their texts; rows that share key and
    text are one document and get equal results. Texts shorter than the window stay whole. Kept bytes may
    begin or end inside a character.
    """
    data = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{key}`").alias("doc"), data.alias("data"))
    repeated = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").limit(1).count() > 0
    # an even tie costs nothing in the shuffles; it is needed only where keys repeat
    rows = rows.select("doc", (F.xxhash64("data") if repeated else F.lit(0).cast("long")).alias("tie"), "data")
    ranges = repeated_ranges(rows, length).groupBy("doc", "tie").agg(F.collect_set(F.struct("a", "b")).alias("_ranges"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc", "tie")]
    joined = rows.alias("l").join(ranges.alias("r"), same[0] & same[1], "left").select("l.doc", "data", "_ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, n_removed, n_spans, kept, sums = [], [], [], [], []
            for value, found in zip(b.column("data"), b.column("_ranges")):
                whole = value.as_py() or b""
                pieces, removed, spans = cut(whole, found.as_py() or [])
                rest = b"".join(pieces)
                n_bytes.append(len(whole))
                n_removed.append(removed)
                n_spans.append(spans)
                kept.append(rest)
                sums.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), *[pa.array(v, pa.int64()) for v in (n_bytes, n_removed, n_spans)],
                 pa.array(kept, pa.binary()), pa.array(sums)],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = joined.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, n_bytes long, n_removed long, "
                                 "n_spans long, kept binary, kept_sha256 string")
    return out.withColumnRenamed("doc", key)
