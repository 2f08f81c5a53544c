"""From irregular rows to gap-free segments on a regular grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorweave.operators import ordered
from sensorweave.operators.ordered import (
    attach_by_chunk, carry, chunk_bounds, nearest_known, spread_over_chunks, with_chunk,
)
from sensorweave.spec import MICROS, SeriesSpec, from_micros, micros, null_safe

SEGMENT = "segment_id"


def _cells(df: DataFrame, spec: SeriesSpec, max_gap_s: float | None) -> DataFrame:
    """One row per (series, time cell): first and last instant, segment number, cell before it.

    A cell is no wider than the allowed gap, so no break can fall inside one; only the cells, which
    a partial aggregate makes from the rows, have to be put in order.
    """
    keys = list(spec.keys)
    cells = df.groupBy(*keys, "_cell").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    cells = carry(cells, keys, "_cell", {"_before": ("max", F.col("_last"))}, spec.levels)
    opens = F.col("_before").isNull()
    if max_gap_s is not None:
        opens = opens | (F.col("_first") - F.col("_before") > int(round(max_gap_s * MICROS)))
    cells = cells.withColumn("_opens", opens)
    start = F.when(F.col("_opens"), F.col("_first"))
    cells = carry(cells, keys, "_cell", {"_seen": ("sum", F.col("_opens").cast("long")), "_since": ("last", start)}, spec.levels)
    return cells.withColumns({
        SEGMENT: F.coalesce("_seen", F.lit(0)) + F.col("_opens").cast("long") - 1,
        "_start": F.coalesce(start, "_since"),
        "_before": F.when(~F.col("_opens"), F.col("_before")),
    }).drop("_opens", "_seen", "_since")


@null_safe
def segment_by_gap(df: DataFrame, spec: SeriesSpec, max_gap_s: float) -> DataFrame:
    """Number the stretches between gaps longer than ``max_gap_s`` seconds.

    A gap of exactly ``max_gap_s`` does not split. The raw rows are never sorted.
    """
    width = max(int(max_gap_s * MICROS), 1)
    df = df.withColumn("_t", micros(spec.ts))
    df = df.withColumn("_cell", F.floor(F.col("_t") / width))
    cells = _cells(df, spec, max_gap_s).select(*spec.keys, "_cell", SEGMENT)
    return df.join(cells, [*spec.keys, "_cell"]).drop("_t", "_cell")


@null_safe
def segments(df: DataFrame, spec: SeriesSpec, max_gap_s: float) -> DataFrame:
    """One row per segment: ``start_ts``, ``end_ts``."""
    width = max(int(max_gap_s * MICROS), 1)
    df = df.select(*spec.keys, micros(spec.ts).alias("_t"))
    df = df.withColumn("_cell", F.floor(F.col("_t") / width))
    return (
        _cells(df, spec, max_gap_s).groupBy(*spec.keys, SEGMENT)
        .agg(F.min("_first").alias("_lo"), F.max("_last").alias("_hi"))
        .select(*spec.keys, SEGMENT, from_micros(F.col("_lo")).alias("start_ts"),
                from_micros(F.col("_hi")).alias("end_ts"))
    )


@null_safe
def grid_segments(df: DataFrame, spec: SeriesSpec, step_s: int, max_gap_s: float | None,
                  values: Mapping[str, Column]) -> DataFrame:
    """Gap segmentation and a dense regular grid inside each segment.

    ``values`` maps output names to aggregates, e.g. ``{"t_in": F.avg("t_in")}``. Grid points are
    aligned to multiples of ``step_s``; points without rows are kept with null values. Adds
    ``segment_id``, ``slot`` (0 at the segment's first grid point) and the grid time under ``spec.ts``.
    Without ``max_gap_s`` each series is one segment.

    The rows are aggregated once by grid point (with map-side partial sums); the empty points come
    from the much smaller cell table, so no row of a segment has to meet the others in one task.
    """
    if max_gap_s is not None and max_gap_s < step_s:
        raise ValueError("max_gap_s must be at least step_s")
    keys = list(spec.keys)
    step = int(step_s * MICROS)
    bins_per_cell = ordered.CHUNK_ROWS if max_gap_s is None else int(max_gap_s // step_s)
    timed = df.withColumn("_t", micros(spec.ts)).withColumn("_bin", F.floor(F.col("_t") / step))
    grid = timed.groupBy(*keys, "_bin").agg(*[v.alias(n) for n, v in values.items()])

    marks = timed.select(*keys, "_t", F.expr(f"floor(_bin / {bins_per_cell})").alias("_cell"))
    cells = _cells(marks, spec, max_gap_s)

    def bin_of(name: str) -> Column:
        return F.floor(F.col(name) / step)

    cells = cells.select(
        *keys, SEGMENT, bin_of("_start").alias("_origin"),
        F.coalesce(bin_of("_before") + 1, bin_of("_first")).alias("_lo"), bin_of("_last").alias("_hi"))
    # Two steps, so that a long empty stretch never becomes one huge array.
    first, last = F.floor(F.col("_lo") / ordered.CHUNK_ROWS), F.floor(F.col("_hi") / ordered.CHUNK_ROWS)
    pieces = cells.withColumn("_piece", F.explode(F.sequence(first, last)))
    # The cells of a series left its window in one task; the points they stand for should not.
    pieces = pieces.repartition(*keys, "_piece")
    dense = pieces.select(*keys, SEGMENT, "_origin", F.explode(F.sequence(
        F.greatest(F.col("_lo"), F.col("_piece") * ordered.CHUNK_ROWS),
        F.least(F.col("_hi"), F.col("_piece") * ordered.CHUNK_ROWS + (ordered.CHUNK_ROWS - 1)))).alias("_bin"))
    dense = dense.withColumn(spec.slot, F.col("_bin") - F.col("_origin"))
    return (
        dense.join(grid, [*keys, "_bin"], "left")
        .select(*keys, SEGMENT, spec.slot, from_micros(F.col("_bin") * step).alias(spec.ts), *values)
    )


def resample(df: DataFrame, spec: SeriesSpec, step_s: int, values: Mapping[str, Column]) -> DataFrame:
    """Dense bins of ``step_s`` seconds between the first and the last row of each series (A4)."""
    return grid_segments(df, spec, step_s, None, values).drop(SEGMENT)


@null_safe(unless="best")
def align_rate(df: DataFrame, spec: SeriesSpec, every: int, cols: Sequence[str],
               best: DataFrame | None = None) -> DataFrame:
    """Keep every ``every``-th slot, from the phase with the fewest null cells.

    Ties go to the lowest phase; null totals are not normalised by row count. ``slot`` is renumbered.
    ``best`` may pass in the result of ``best_phase``; the keys are then matched as they are, so pack
    them first (``spec.pack``) where they may be null.
    """
    if best is None:
        best = best_phase(df, spec, every, cols)
    slot = F.col(spec.slot)
    # Chunks of every * CHUNK_ROWS old slots are chunks of CHUNK_ROWS new ones.
    return (
        attach_by_chunk(_wide_chunks(df, spec, every), best, spec)
        # Written as a difference so it stays a filter: as an equality it would become a join key and
        # cost a shuffle of its own.
        .where((slot - F.col("phase")) % every == 0)
        .withColumn(spec.slot, F.expr(f"(`{spec.slot}` - phase) div {int(every)}"))
        .drop("phase")
    )


def _wide_chunks(df: DataFrame, spec: SeriesSpec, every: int) -> DataFrame:
    return with_chunk(df.drop(spec.chunk), spec, int(every) * ordered.CHUNK_ROWS)


def phase_nulls(df: DataFrame, spec: SeriesSpec, every: int, cols: Sequence[str]) -> DataFrame:
    """Null cells per (series, phase)."""
    nulls = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    df = _wide_chunks(df, spec, every)
    return (
        df.groupBy(*spec.keys, (F.col(spec.slot) % every).alias("phase"))
        .agg(F.sum(nulls).alias("nulls"), *chunk_bounds(spec))
    )


def best_phase(df: DataFrame, spec: SeriesSpec, every: int, cols: Sequence[str]) -> DataFrame:
    by_phase = phase_nulls(df, spec, every, cols)
    return by_phase.groupBy(*spec.keys).agg(
        F.min(F.struct("nulls", "phase"))["phase"].alias("phase"),
        F.min("_lo_chunk").alias("_lo_chunk"), F.max("_hi_chunk").alias("_hi_chunk"),
    )


def null_free_parts(df: DataFrame, spec: SeriesSpec, target: str, max_run: int) -> DataFrame:
    """The stretches between runs of more than ``max_run`` nulls: ``part_id`` (first slot), ``_hi_slot``.

    Needs a dense grid. One aggregate per chunk keeps the slots where ``target`` is known (at most a
    chunk's worth); all further work is on one row per chunk.
    """
    keys = list(spec.keys)
    df = with_chunk(df.select(*keys, spec.slot, target), spec)
    chunks = df.groupBy(*keys, spec.chunk).agg(
        F.min(spec.slot).alias("_lo"), F.max(spec.slot).alias("_hi"),
        F.sort_array(F.collect_list(F.when(F.col(target).isNotNull(), F.col(spec.slot)))).alias("_known"))
    # Only cuts and edges go on to the per-series windows; the slots themselves stay behind.
    last = F.size("_known") - 1
    chunks = chunks.select(
        *keys, "_lo", "_hi", spec.chunk, F.get("_known", F.lit(0)).alias("_from"), F.get("_known", last).alias("_to"),
        F.filter(F.arrays_zip(F.slice("_known", F.lit(1), F.greatest(last, F.lit(0))).alias("a"),
                              F.slice("_known", F.lit(2), F.greatest(last, F.lit(0))).alias("b")),
                 lambda p: p["b"] - p["a"] - 1 > max_run).alias("_inner"))
    back = {"_seen": ("last", F.col("_to")), "_lo_before": ("min", F.col("_lo")), "_hi_before": ("max", F.col("_hi"))}
    ahead = {"_lo_behind": ("min", F.col("_lo")), "_hi_behind": ("max", F.col("_hi"))}
    chunks = carry(carry(chunks, keys, spec.chunk, back, spec.levels), keys, spec.chunk, ahead, spec.levels, backward=True)
    chunks = chunks.withColumns({"_first": F.least("_lo", "_lo_before", "_lo_behind"), "_last": F.greatest("_hi", "_hi_before", "_hi_behind")})
    none = F.array().cast("array<bigint>")

    def cut(left: Column, right: Column, applies: Column) -> Column:
        pair = F.array(F.struct(left.alias("a"), right.alias("b")))
        return F.when(applies & (right - left - 1 > max_run), pair).otherwise(
            F.array().cast("array<struct<a:bigint,b:bigint>>"))

    # Just outside the series counts as known, so runs at both ends are runs like any other.
    seen = F.coalesce(F.col("_seen"), F.col("_first") - 1)
    chunks = chunks.withColumn("_cuts", F.concat(
        cut(seen, F.col("_from"), F.col("_from").isNotNull()), F.col("_inner"),
        cut(F.coalesce(F.col("_to"), seen), F.col("_last") + 1, F.col("_hi") == F.col("_last"))))
    chunks = carry(chunks, keys, spec.chunk, {"_next": ("last", F.expr("get(_cuts, 0).a"))}, spec.levels, backward=True)
    start = F.when(F.col("_lo") == F.col("_first"), F.array(F.col("_first"))).otherwise(none)
    chunks = chunks.withColumn("_starts", F.concat(start, F.expr("_cuts.b"))).withColumn(
        "_ends", F.concat(F.expr("_cuts.a"), F.array(F.coalesce(F.col("_next"), F.col("_last")))))
    # Outside the first chunk the first end closes a part that an earlier chunk opened.
    ends = F.when(F.col("_lo") == F.col("_first"), F.col("_ends")).otherwise(
        F.expr("slice(_ends, 2, size(_ends) - 1)"))
    return (
        chunks.select(*keys, F.explode(F.arrays_zip(
            F.col("_starts").alias("part_id"), ends.alias("_hi_slot"))).alias("_part"))
        .select(*keys, "_part.part_id", "_part._hi_slot")
        .where("part_id <= _hi_slot")
    )


def attach_parts(df: DataFrame, spec: SeriesSpec, parts: DataFrame) -> DataFrame:
    """Keep the rows that lie in one of ``parts`` and add its ``part_id``. Null keys as in ``align_rate`` with ``best``."""
    df = with_chunk(df, spec)
    spread = spread_over_chunks(
        parts.withColumns({"_a": F.expr(f"part_id div {ordered.CHUNK_ROWS}"), "_b": F.expr(f"_hi_slot div {ordered.CHUNK_ROWS}")}),
        spec, "_a", "_b")
    return (
        df.join(spread, [*spec.keys, spec.chunk])
        .where(F.col(spec.slot).between(F.col("part_id"), F.col("_hi_slot")))
        .drop("_hi_slot")
    )


@null_safe
def split_on_null_runs(df: DataFrame, spec: SeriesSpec, target: str, max_run: int) -> DataFrame:
    """Drop runs of more than ``max_run`` nulls in ``target`` and split there.

    Needs a dense grid. Adds ``part_id``: the slot at which the kept stretch begins. Slots keep their
    values.
    """
    return attach_parts(df, spec, null_free_parts(df, spec, target, max_run))


@null_safe
def keep_long(df: DataFrame, spec: SeriesSpec, min_rows: int) -> DataFrame:
    """Keep series with strictly more than ``min_rows`` rows."""
    df = with_chunk(df, spec)
    long = (
        df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("_n"), *chunk_bounds(spec))
        .where(F.col("_n") > min_rows).drop("_n")
    )
    return attach_by_chunk(df, long, spec)


@null_safe(unless="cluster")
def interpolate(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], cluster: Sequence[str] | None = None) -> DataFrame:
    """Linear interpolation by row position (W8): leading nulls stay, trailing nulls repeat the last value.

    ``cluster`` as in ``nearest_known``.
    """
    order = df.columns
    df = with_chunk(df, spec)
    df = nearest_known(df, spec, {c: F.col(c) for c in cols}, cluster)
    slot = F.col(spec.slot)

    def filled(c: str) -> Column:
        a, b = F.col(f"{c}_prev"), F.col(f"{c}_next")
        sa, sb = F.col(f"{c}_prev_slot"), F.col(f"{c}_next_slot")
        between = a + (b - a) * (slot - sa) / (sb - sa)
        return F.coalesce(F.col(c), between, a)

    return df.withColumns({c: filled(c) for c in cols}).select(*order)


def largest_segment(df: DataFrame, spec: SeriesSpec, segment: str = SEGMENT) -> DataFrame:
    """The segment with most rows, ties to the lowest id."""
    outer = [k for k in spec.keys if k != segment]
    sizes = df.groupBy(*outer, segment).agg(F.count(F.lit(1)).alias("n_rows"))
    best = F.max(F.struct(F.col("n_rows"), (-F.col(segment)).alias("_neg")))
    return sizes.groupBy(*outer).agg(best.alias("_best")).select(
        *outer, (-F.col("_best._neg")).alias(segment), F.col("_best.n_rows").alias("n_rows"))
