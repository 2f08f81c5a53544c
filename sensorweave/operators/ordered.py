"""Order-sensitive building blocks that never sort a whole series in one task.

A window over ``partitionBy(series)`` puts a long series into one task. Everything here works in
two levels instead: rows are handled inside ``(series, chunk)``; one summary row per chunk carries
what crosses a chunk border, and only that small summary is ordered per series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorweave.spec import MICROS, SeriesSpec, micros, null_safe

# Rows of a gridded series that one window sort takes at once.
CHUNK_ROWS = 4096

_ALL_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO_HERE = (Window.unboundedPreceding, 0)


def with_chunk(df: DataFrame, spec: SeriesSpec, rows: int | None = None) -> DataFrame:
    """Add the chunk column to a gridded table unless it is there already."""
    if spec.chunk in df.columns:
        return df
    return df.withColumn(spec.chunk, F.expr(f"`{spec.slot}` div {int(rows or CHUNK_ROWS)}"))


def join_keys(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on (packed) key columns; a cross join with a one-row table when ``on`` is empty."""
    on = list(on)
    if not on:
        return df.crossJoin(F.broadcast(other))
    return df.join(other, on, how)


def spread_over_chunks(table: DataFrame, spec: SeriesSpec, lo: str, hi: str) -> DataFrame:
    """Repeat one-row-per-series facts once per chunk in ``[lo, hi]``.

    Joining on ``keys + chunk`` rather than on ``keys`` keeps a series that holds a large share of
    the rows spread over many tasks, and reuses the partitioning of the chunked table.
    """
    return table.withColumn(spec.chunk, F.explode(F.sequence(F.col(lo), F.col(hi)))).drop(lo, hi)


def attach_by_chunk(df: DataFrame, facts: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Join facts that hold ``_lo_chunk``/``_hi_chunk`` per series onto a chunked table."""
    spread = spread_over_chunks(facts, spec, "_lo_chunk", "_hi_chunk")
    return df.join(spread, [*spec.keys, spec.chunk])


def chunk_bounds(spec: SeriesSpec) -> list[Column]:
    return [F.min(spec.chunk).alias("_lo_chunk"), F.max(spec.chunk).alias("_hi_chunk")]


#: Summary rows that one window orders: blocks of this many are carried by a summary of their own.
FAN = 1 << 14


def carry(df: DataFrame, keys: Sequence[str], at: str, values: Mapping[str, tuple[str, Column]], levels: int = 1,
          backward: bool = False) -> DataFrame:
    """What the blocks before a block hand on to it, by an associative scan of several levels.

    ``df`` has one row per series (``keys``) and block (``at``, a long). ``values`` maps a new column to an operation and
    a column of the block: ``sum``, ``max``, ``min``, or ``last`` (the nearest known value). A window orders the blocks of
    one span of ``FAN`` only; each span is one row of the next level, which hands on to it in the same way, so with
    ``levels`` of them no window grows with a series of up to ``FAN ** levels`` blocks. The last level is one window per
    series. ``backward`` scans from the end.
    """
    keys = list(keys)
    order = F.desc(at) if backward else F.asc(at)
    over = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, True)}
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least, "last": lambda near, far: F.coalesce(near, far)}
    temp = {name: f"_in{levels}_{i}" for i, name in enumerate(values)}
    df = df.withColumns({temp[name]: c for name, (_, c) in values.items()})
    if levels == 1:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(*_ALL_BEFORE)
        return df.withColumns({name: over[op](temp[name]).over(before) for name, (op, _) in values.items()}).drop(*temp.values())
    span = f"_span{levels}"
    df = df.withColumn(span, F.floor(F.col(at) / FAN))
    before = Window.partitionBy(*keys, span).orderBy(order).rowsBetween(*_ALL_BEFORE)
    df = df.withColumns({name: over[op](temp[name]).over(before) for name, (op, _) in values.items()})

    def total(op: str, c: str) -> Column:
        if op != "last":
            return over[op](c)
        known = F.when(F.col(c).isNotNull(), F.col(at))
        return (F.min_by if backward else F.max_by)(c, known)

    far = {name: f"_far{levels}_{i}" for i, name in enumerate(values)}
    spans = df.groupBy(*keys, span).agg(*[total(op, temp[name]).alias(f"_all{levels}_{i}") for i, (name, (op, _)) in enumerate(values.items())])
    spans = carry(spans, keys, span, {far[name]: (op, F.col(f"_all{levels}_{i}")) for i, (name, (op, _)) in enumerate(values.items())}, levels - 1, backward)
    spans = spans.select(*keys, span, *far.values())
    # one row per span: the join spreads a long series by its spans
    df = df.join(spans, [*keys, span])
    return df.withColumns({name: both[op](F.col(name), F.col(far[name])) for name, (op, _) in values.items()}).drop(
        span, *temp.values(), *far.values())


def _time_bucket(spec: SeriesSpec, seconds: int) -> Column:
    return F.floor(micros(spec.ts) / (seconds * MICROS))


def bucket_width(df: DataFrame, spec: SeriesSpec, max_rows: int = 250_000,
                 widths: Sequence[int] = (86_400, 3600, 600, 60, 10, 1)) -> int:
    """The widest time bucket in seconds that holds at most ``max_rows`` rows of any one series.

    Runs one small aggregate job per width tried, widest first; the narrowest is returned if none
    fits. For ``bucket_seconds`` of ``add_slot``, ``previous_time`` and ``minute_gaps``, which measure where none is given.
    """
    for seconds in widths:
        counts = df.groupBy(*spec.keys, _time_bucket(spec, seconds).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        most = counts.agg(F.max("_n")).first()[0]
        if most is None or most <= max_rows:
            return seconds
    return widths[-1]


@null_safe
def add_slot(df: DataFrame, spec: SeriesSpec, bucket_seconds: int | None = None) -> DataFrame:
    """0-based row position inside each series, for rows that sit on no grid.

    Rows are numbered inside time buckets; a scan over the bucket counts (``carry``) gives the offset. One
    task sorts one bucket of one series; its width is measured (``bucket_width``) unless given.
    """
    bucket_seconds = bucket_seconds or bucket_width(df, spec)
    df = df.withColumn("_bucket", _time_bucket(spec, bucket_seconds))
    keys = list(spec.keys)
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = carry(counts, keys, "_bucket", {"_offset": ("sum", F.col("_n"))}, spec.levels).select(
        *keys, "_bucket", F.coalesce("_offset", F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*spec.order)
    return (
        df.join(offsets, [*keys, "_bucket"])
        .withColumn(spec.slot, (F.row_number().over(inner) - 1 + F.col("_offset")).cast("long"))
        .drop("_bucket", "_offset")
    )


@null_safe
def previous_time(df: DataFrame, spec: SeriesSpec, out: str, bucket_seconds: int | None = None) -> DataFrame:
    """Timestamp of the row before, null on the first row of a series. ``bucket_seconds`` as in ``add_slot``."""
    bucket_seconds = bucket_seconds or bucket_width(df, spec)
    df = df.withColumn("_bucket", _time_bucket(spec, bucket_seconds))
    keys = list(spec.keys)
    ends = df.groupBy(*keys, "_bucket").agg(F.max(spec.ts).alias("_last"))
    before = carry(ends, keys, "_bucket", {"_carry": ("last", F.col("_last"))}, spec.levels).select(*keys, "_bucket", "_carry")
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*spec.order)
    return (
        df.join(before, [*keys, "_bucket"])
        .withColumn(out, F.coalesce(F.lag(spec.ts).over(inner), F.col("_carry")))
        .drop("_bucket", "_carry")
    )


@null_safe
def minute_gaps(df: DataFrame, spec: SeriesSpec, out: str = "gap_min", **options) -> DataFrame:
    """Minutes since the row before."""
    df = previous_time(df, spec, "_prev_ts", **options)
    return df.withColumn(out, (micros(spec.ts) - micros("_prev_ts")) / (60.0 * MICROS)).drop("_prev_ts")


@null_safe(unless="cluster")
def nearest_known(df: DataFrame, spec: SeriesSpec, values: Mapping[str, Column],
                  cluster: Sequence[str] | None = None) -> DataFrame:
    """For each named nullable value: the closest known one at or before, and at or after, the row.

    Adds ``<name>_prev``, ``<name>_prev_slot``, ``<name>_next``, ``<name>_next_slot``. Needs the slot
    and chunk columns. One shuffle on ``keys + chunk``; runs of nulls may span any number of chunks.

    ``cluster`` names the keys, fewer than the series keys, that a table already partitioned by
    ``cluster + chunk`` is partitioned by; that shuffle is then reused.
    """
    keys = [*spec.keys, spec.chunk]
    slot = F.col(spec.slot)
    df = df.withColumns({f"_v_{name}": value for name, value in values.items()})
    df = df.withColumns({f"_s_{name}": F.when(F.col(f"_v_{name}").isNotNull(), slot) for name in values})
    edges = []
    for name in values:
        v, s = f"_v_{name}", f"_s_{name}"
        edges += [
            F.min_by(v, s).alias(f"_fv_{name}"), F.min(s).alias(f"_fs_{name}"),
            F.max_by(v, s).alias(f"_lv_{name}"), F.max(s).alias(f"_ls_{name}"),
        ]
    chunks = df.groupBy(*keys).agg(*edges)
    ahead = {f"_cpv_{n}": ("last", F.col(f"_lv_{n}")) for n in values} | {f"_cps_{n}": ("last", F.col(f"_ls_{n}")) for n in values}
    behind = {f"_cnv_{n}": ("last", F.col(f"_fv_{n}")) for n in values} | {f"_cns_{n}": ("last", F.col(f"_fs_{n}")) for n in values}
    chunks = carry(carry(chunks, spec.keys, spec.chunk, ahead, spec.levels), spec.keys, spec.chunk, behind, spec.levels, backward=True)
    chunks = chunks.select(*keys, *ahead, *behind)
    if cluster is None:
        df = df.join(chunks, keys)
    else:
        # The other keys are matched as a range: an equality would join, and shuffle, by them too.
        rest = [k for k in spec.keys if k not in cluster]
        chunks = chunks.withColumnsRenamed({k: f"_c_{k}" for k in rest})
        df = df.join(chunks, [*cluster, spec.chunk])
        for k in rest:
            df = df.where(F.col(k).between(F.col(f"_c_{k}"), F.col(f"_c_{k}")))
        df = df.drop(*[f"_c_{k}" for k in rest])
    up = Window.partitionBy(*keys).orderBy(spec.slot).rowsBetween(*_UP_TO_HERE)
    down = Window.partitionBy(*keys).orderBy(F.desc(spec.slot)).rowsBetween(*_UP_TO_HERE)
    found, scratch = {}, []
    for name in values:
        v, s = f"_v_{name}", f"_s_{name}"
        found[f"{name}_prev"] = F.coalesce(F.last(v, True).over(up), F.col(f"_cpv_{name}"))
        found[f"{name}_prev_slot"] = F.coalesce(F.last(s, True).over(up), F.col(f"_cps_{name}"))
        found[f"{name}_next"] = F.coalesce(F.last(v, True).over(down), F.col(f"_cnv_{name}"))
        found[f"{name}_next_slot"] = F.coalesce(F.last(s, True).over(down), F.col(f"_cns_{name}"))
        scratch += [v, s, f"_cpv_{name}", f"_cps_{name}", f"_cnv_{name}", f"_cns_{name}"]
    return df.withColumns(found).drop(*scratch)


def with_halo(df: DataFrame, spec: SeriesSpec, back: int, ahead: int, rows: int | None = None) -> DataFrame:
    """Copy edge rows into the neighbouring chunk so fixed-offset frames see all the rows they need.

    Adds ``_home`` (the chunk a row belongs to) and ``_frame`` (the chunk it is copied into). Frames
    partitioned by ``keys + _frame`` then reach ``back`` rows behind and ``ahead`` rows in front;
    keep the rows with ``_home = _frame`` afterwards (``drop_halo``).
    """
    rows = max(int(rows or CHUNK_ROWS), back, ahead, 1)
    slot = F.col(spec.slot)
    df = df.withColumn("_home", F.expr(f"`{spec.slot}` div {rows}"))
    home = F.col("_home")
    targets = F.array_compact(F.array(
        home,
        F.when((slot < home * rows + ahead) & (home > 0), home - 1),
        F.when(slot >= (home + 1) * rows - back, home + 1),
    ))
    return df.withColumn("_frame", F.explode(targets))


def halo_window(spec: SeriesSpec):
    return Window.partitionBy(*spec.keys, "_frame").orderBy(spec.slot)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_home = _frame").drop("_home", "_frame")


@null_safe
def run_lengths(df: DataFrame, spec: SeriesSpec, flag: Column) -> DataFrame:
    """Runs of equal flag values along the slots (W5): ``run_start`` slot and ``run_len`` rows.

    A run is found by its edges, never by grouping its rows, so one run may hold most of the table.
    """
    df = with_halo(with_chunk(df, spec).withColumn("_flag", F.coalesce(flag, F.lit(False))), spec, 1, 1)
    w = halo_window(spec)
    df = df.withColumns({"_before": F.lag("_flag").over(w), "_after": F.lead("_flag").over(w)})
    df = drop_halo(df)
    opens = F.when(~F.col("_flag").eqNullSafe(F.col("_before")), F.col(spec.slot))
    closes = F.when(~F.col("_flag").eqNullSafe(F.col("_after")), F.col(spec.slot))
    df = nearest_known(df, spec, {"_open": opens, "_close": closes})
    return (
        df.withColumn("run_start", F.col("_open_prev_slot"))
        .withColumn("run_len", F.col("_close_next_slot") - F.col("_open_prev_slot") + 1)
        .drop("_flag", "_before", "_after", *[f"{n}_{e}" for n in ("_open", "_close")
                                               for e in ("prev", "prev_slot", "next", "next_slot")])
    )
