"""Ordered building blocks and cleaning."""

from pyspark.sql import functions as F

from sensorweave.catalog.base import (
    EV, R, SEG, SEGMENTED_SQL, SENS, SENSORS, STEP, events,
    query, rnd, segmented, wide_events,
)
from sensorweave.operators.ordered import minute_gaps, run_lengths
from sensorweave.operators.segments import (
    align_rate, best_phase, interpolate, keep_long, largest_segment, phase_nulls, segment_by_gap,
    segments, split_on_null_runs,
)
from sensorweave.plans.cleaning import CleaningParams, clean

_ROUNDED = ", ".join(f"{R(s)} AS {s}" for s in SENSORS)


def rounded(cols=SENSORS):
    return [rnd(c).alias(c) for c in cols]


@query("w1_time_difference", f"""
SELECT event_id, {R("(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 60000000.0")}
  AS gap_min FROM events""")
def _(spark, d):
    return minute_gaps(events(spark, d), EV).select("event_id", rnd("gap_min").alias("gap_min"))


_GAP_SQL = """
WITH b AS (SELECT event_id, event_type, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts))
  OVER (PARTITION BY event_type ORDER BY ts, event_id) > 5400000000 THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT event_id, event_type, ts, sum(brk) OVER (PARTITION BY event_type ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING)::BIGINT AS segment_id FROM b)
"""


@query("w2_gap_segments", _GAP_SQL + "SELECT event_id, event_type, segment_id FROM s")
def _(spark, d):
    return segment_by_gap(events(spark, d), EV, 5400).select("event_id", "event_type", "segment_id")


@query("w2_segment_bounds", _GAP_SQL + """
SELECT event_type, segment_id, min(ts) AS start_ts, max(ts) AS end_ts FROM s GROUP BY ALL""")
def _(spark, d):
    return segments(events(spark, d), EV, 5400)


@query("w3_segment_grid", f"WITH {SEGMENTED_SQL} SELECT segment_id, slot, ts, {_ROUNDED} FROM seg")
def _(spark, d):
    return segmented(spark, d).select("segment_id", "slot", "ts", *rounded())


_NULLS = " + ".join(f"({s} IS NULL)::BIGINT" for s in SENSORS)
_PHASE_SQL = SEGMENTED_SQL + f""", phases AS (SELECT segment_id, slot % 2 AS phase, sum({_NULLS})::BIGINT AS nulls
  FROM seg GROUP BY ALL),
best AS (SELECT segment_id, arg_min(phase, nulls * 10 + phase) AS phase FROM phases GROUP BY segment_id),
aligned AS (SELECT segment_id, (slot - phase) // 2 AS slot, ts, {", ".join(SENSORS)}
  FROM seg JOIN best USING (segment_id) WHERE slot % 2 = phase)"""


@query("a8_null_cells_by_phase", f"WITH {_PHASE_SQL} SELECT segment_id, phase, nulls FROM phases")
def _(spark, d):
    return phase_nulls(segmented(spark, d), SEG, 2, SENSORS).select("segment_id", "phase", "nulls")


@query("a8_best_phase", f"WITH {_PHASE_SQL} SELECT segment_id, phase FROM best")
def _(spark, d):
    return best_phase(segmented(spark, d), SEG, 2, SENSORS).select("segment_id", "phase")


@query("w4_rate_alignment", f"WITH {_PHASE_SQL} SELECT segment_id, slot, ts, {_ROUNDED} FROM aligned")
def _(spark, d):
    return align_rate(segmented(spark, d), SEG, 2, SENSORS).select("segment_id", "slot", "ts", *rounded())


def runs_sql(source: str, flag: str) -> str:
    return f""", flagged AS (SELECT *, {flag} AS f FROM {source}),
changed AS (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER (PARTITION BY segment_id ORDER BY slot)
  OR row_number() OVER (PARTITION BY segment_id ORDER BY slot) = 1 THEN 1 ELSE 0 END AS chg FROM flagged),
runs AS (SELECT *, sum(chg) OVER (PARTITION BY segment_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS run FROM changed),
sized AS (SELECT *, count(*) OVER (PARTITION BY segment_id, run) AS run_len,
  min(slot) OVER (PARTITION BY segment_id, run) AS run_start FROM runs)"""


@query("w5_run_lengths", f"WITH {SEGMENTED_SQL} {runs_sql('seg', 'view IS NULL')} "
       "SELECT segment_id, slot, run_start, run_len FROM sized")
def _(spark, d):
    return run_lengths(segmented(spark, d), SEG, F.col("view").isNull()).select(
        "segment_id", "slot", "run_start", "run_len")


_SPLIT_SQL = _PHASE_SQL + runs_sql("aligned", "view IS NULL") + """,
bad AS (SELECT *, f AND run_len > 2 AS invalid FROM sized),
cut AS (SELECT *, CASE WHEN invalid IS DISTINCT FROM lag(invalid) OVER (PARTITION BY segment_id ORDER BY slot)
  THEN 1 ELSE 0 END AS chg2 FROM bad),
grp AS (SELECT *, sum(chg2) OVER (PARTITION BY segment_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS g FROM cut),
parts AS (SELECT *, min(slot) OVER (PARTITION BY segment_id, g) AS part_id FROM grp WHERE NOT invalid)"""


def _parts(spark, d):
    return split_on_null_runs(align_rate(segmented(spark, d), SEG, 2, SENSORS), SEG, "view", 2)


PART = SEG.within("part_id")


@query("w6_null_run_split", f"WITH {_SPLIT_SQL} SELECT segment_id, part_id, slot, {_ROUNDED} FROM parts")
def _(spark, d):
    return _parts(spark, d).select("segment_id", "part_id", "slot", *rounded())


_LONG_SQL = _SPLIT_SQL + """,
long AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY segment_id, part_id) AS part_n FROM parts) WHERE part_n > 12)"""


@query("w7_keep_long_segments", f"WITH {_LONG_SQL} SELECT segment_id, part_id, slot, ts FROM long")
def _(spark, d):
    return keep_long(_parts(spark, d), PART, 12).select("segment_id", "part_id", "slot", "ts")


def interpolate_sql(source: str, part: str, cols=SENSORS) -> str:
    """Linear fill by row position: nearest known values on both sides, trailing nulls repeat the last."""
    ups = ", ".join(
        f"last_value(CASE WHEN {c} IS NOT NULL THEN slot END IGNORE NULLS) OVER up AS {c}_s0, "
        f"last_value({c} IGNORE NULLS) OVER up AS {c}_v0, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN slot END IGNORE NULLS) OVER down AS {c}_s1, "
        f"first_value({c} IGNORE NULLS) OVER down AS {c}_v1" for c in cols)
    filled = ", ".join(
        f"coalesce({c}, {c}_v0 + ({c}_v1 - {c}_v0) * (slot - {c}_s0) / ({c}_s1 - {c}_s0)::DOUBLE, {c}_v0) AS {c}"
        for c in cols)
    return f""", near_known AS (SELECT *, {ups} FROM {source}
  WINDOW up AS (PARTITION BY {part} ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY {part} ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT {part}, slot, ts, {filled} FROM near_known)"""


@query("w8_linear_interpolation", f"WITH {SEGMENTED_SQL} {interpolate_sql('seg', 'segment_id')} "
       f"SELECT segment_id, slot, {_ROUNDED} FROM filled")
def _(spark, d):
    return interpolate(segmented(spark, d), SEG, SENSORS).select("segment_id", "slot", *rounded())


CLEAN_PARAMS = CleaningParams(step_s=STEP, max_gap_s=1800, every=2, max_null_run=2, min_rows=12)
CLEAN_SQL = _LONG_SQL + interpolate_sql("long", "segment_id, part_id") + f""",
cleaned AS (SELECT segment_id, part_id, slot - part_id AS slot, ts, {", ".join(SENSORS)} FROM filled)"""


def cleaned(spark, d):
    return clean(wide_events(spark, d), SENS, SENSORS, "view", CLEAN_PARAMS)


@query("w9_clean_series", f"WITH {CLEAN_SQL} SELECT segment_id, part_id, slot, ts, {_ROUNDED} FROM cleaned")
def _(spark, d):
    return cleaned(spark, d).select("segment_id", "part_id", "slot", "ts", *rounded())


@query("t3_largest_segment", f"""WITH {SEGMENTED_SQL}, sizes AS (SELECT segment_id, count(*) AS n_rows FROM seg GROUP BY 1)
SELECT segment_id, n_rows FROM sizes ORDER BY n_rows DESC, segment_id LIMIT 1""")
def _(spark, d):
    return largest_segment(segmented(spark, d), SEG)
