"""Fixed-offset features and per-day diagnostics."""

import datetime as dt

from pyspark.sql import functions as F

from sensorweave.catalog.base import (
    DAILY, DAILY_SQL, R, SEG, SEGMENTED_SQL, SENS, SENSORS, complete_sens, daily, query, rnd, segmented,
)
from sensorweave.catalog.calendar import WORK_SQL
from sensorweave.catalog.cleaning import interpolate_sql
from sensorweave.operators.calendar import day_slots, numbered_working_days
from sensorweave.operators.dayshape import best_lag, elapsed, lag_corr, mean_over_days, period_hours, spectrum
from sensorweave.operators.features import lag_embed, lead_target, smooth, windows
from sensorweave.operators.segments import interpolate
from sensorweave.plans.dayreport import day_report
from sensorweave.sources.stage import stage
from sensorweave.plans.supervised import SupervisedParams, supervised


def padded_sql(col: str, over: str, k: int, back: int, ahead: int) -> str:
    """Edge-padded moving mean, written as a plain average over clipped positions."""
    terms = " + ".join(
        f"coalesce(lag({col}, {-o}) OVER {over}, first_value({col}) OVER ({over[1:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
        if o < 0 else
        (f"coalesce(lead({col}, {o}) OVER {over}, last_value({col}) OVER ({over[1:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
         if o > 0 else col)
        for o in range(-back, ahead + 1))
    return f"(({terms}) / {float(k)})"


_D = "(ORDER BY slot)"


@query("w10_centred_average", f"WITH {DAILY_SQL} SELECT d, slot, {R(padded_sql('total', _D, 5, 2, 2), 2)} AS total FROM daily")
def _(spark, d):
    return smooth(daily(spark, d), DAILY, ["total"], 5).select("d", "slot", rnd("total", 2).alias("total"))


@query("w11_trailing_average", f"WITH {DAILY_SQL} SELECT d, slot, {R(padded_sql('total', _D, 5, 4, 0), 2)} AS total FROM daily")
def _(spark, d):
    return smooth(daily(spark, d), DAILY, ["total"], 5, "trailing").select("d", "slot", rnd("total", 2).alias("total"))


@query("w12_delay_corrected_average", f"""WITH {DAILY_SQL},
f AS (SELECT d, slot, n, {padded_sql('total', _D, 5, 4, 0)} AS total FROM daily)
SELECT d, slot, n2 AS n, {R('t2', 2)} AS total FROM (SELECT d, slot, lead(total, 2) OVER (ORDER BY slot) AS t2,
  lead(n, 2) OVER (ORDER BY slot) AS n2, count(*) OVER () AS c FROM f) WHERE slot < c - 2""")
def _(spark, d):
    out = smooth(daily(spark, d), DAILY, ["total"], 5, "delay_corrected")
    return out.select("d", "slot", "n", rnd("total", 2).alias("total"))


@query("w13_lead_target", f"""WITH {SEGMENTED_SQL}
SELECT segment_id, slot, {R('view')} AS view, {R('ahead')} AS ahead FROM (SELECT *, lead(view, 6) OVER w AS ahead,
  lead(slot, 6) OVER w AS has FROM seg WINDOW w AS (PARTITION BY segment_id ORDER BY slot)) WHERE has IS NOT NULL""")
def _(spark, d):
    out = lead_target(segmented(spark, d), SEG, "view", 6, "ahead")
    return out.select("segment_id", "slot", rnd("view").alias("view"), rnd("ahead").alias("ahead"))


_SUP = SupervisedParams(target="view", smoothed=["click", "view"], difference=("click", "view"), kernel=5, ahead=6,
                        start="05:00", end="17:30", removed_days=(dt.date(2024, 1, 10),))
_SUP_COLS = ["click", "view", "diff", "hours_sin", "hours_cos", "target_ahead"]
_S = "(PARTITION BY segment_id ORDER BY slot)"
SUP_SQL = SEGMENTED_SQL + interpolate_sql("seg", "segment_id") + f""",
sm AS (SELECT segment_id, slot, ts, {padded_sql('click', _S, 5, 2, 2)} AS click, {padded_sql('view', _S, 5, 2, 2)} AS view FROM filled),
tgt AS (SELECT *, lead(view, 6) OVER w AS target_ahead, lead(slot, 6) OVER w AS has FROM sm
  WINDOW w AS (PARTITION BY segment_id ORDER BY slot)),
hrs AS (SELECT *, click - view AS diff, sin(2 * pi() * hour(ts) / 24.0) AS hours_sin, cos(2 * pi() * hour(ts) / 24.0) AS hours_cos
  FROM tgt WHERE has IS NOT NULL AND ts::DATE <> DATE '2024-01-10' AND isodow(ts) <= 5
  AND ts::TIME BETWEEN TIME '05:00:00' AND TIME '17:30:00'),
cnt AS (SELECT segment_id, ts::DATE AS d, count(*) AS n FROM hrs GROUP BY ALL),
mx AS (SELECT segment_id, max(n) AS n FROM cnt GROUP BY 1),
sup AS (SELECT h.*, (dense_rank() OVER (PARTITION BY h.segment_id ORDER BY ts::DATE) - 1)::INTEGER AS day_id
  FROM hrs h JOIN cnt ON cnt.segment_id = h.segment_id AND cnt.d = h.ts::DATE JOIN mx ON mx.segment_id = h.segment_id
  WHERE cnt.n = mx.n)"""


def supervised_set(spark, d):
    return supervised(interpolate(segmented(spark, d), SEG, SENSORS), SEG, _SUP, _SUP_COLS)


@query("w15_supervised_set", f"WITH {SUP_SQL} SELECT segment_id, day_id, slot, ts, "
       + ", ".join(f"{R(c)} AS {c}" for c in _SUP_COLS) + " FROM sup")
def _(spark, d):
    return supervised_set(spark, d).select("segment_id", "day_id", "slot", "ts", *[rnd(c).alias(c) for c in _SUP_COLS])


_EMBED_SQL = DAILY_SQL + """, emb4 AS (SELECT slot, lag(total, 18) OVER w AS lag_18, lag(total, 12) OVER w AS lag_12,
  lag(total, 6) OVER w AS lag_6, total AS lag_0, lead(total, 6) OVER w AS target FROM daily WINDOW w AS (ORDER BY slot))"""
_EMBED = ["lag_18", "lag_12", "lag_6", "lag_0", "target"]


@query("w16_lag_embedding", f"WITH {_EMBED_SQL} SELECT slot, " + ", ".join(f"{R(c, 2)} AS {c}" for c in _EMBED)
       + " FROM emb4 WHERE slot >= 118")
def _(spark, d):
    out = lag_embed(daily(spark, d), DAILY, "total", 4, 6, start=118)
    return out.select("slot", *[rnd(c, 2).alias(c) for c in _EMBED])


@query("f13_positional_split", f"WITH {_EMBED_SQL} SELECT slot, {R('lag_0', 2)} AS lag_0, slot - 118 < 500 AS is_train "
       "FROM emb4 WHERE slot >= 118")
def _(spark, d):
    out = lag_embed(daily(spark, d), DAILY, "total", 4, 6, 118)
    return out.select("slot", rnd("lag_0", 2).alias("lag_0"), (F.col("slot") - 118 < 500).alias("is_train"))


@query("j3_self_lookup", f"WITH {DAILY_SQL} SELECT a.slot, {R('a.total', 2)} AS total, {R('b.total', 2)} AS past "
       "FROM daily a JOIN daily b ON b.slot = a.slot - 18")
def _(spark, d):
    df = daily(spark, d)
    past = df.select((F.col("slot") + 18).alias("slot"), F.col("total").alias("past"))
    return df.join(past, "slot").select("slot", rnd("total", 2).alias("total"), rnd("past", 2).alias("past"))


@query("w17_window_tensor", f"""WITH {WORK_SQL}, win AS (SELECT day_id, pos AS slot, view AS target,
  list(click) OVER w AS wc, list(error) OVER w AS we FROM workdays
  WINDOW w AS (PARTITION BY day_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT day_id, slot, {R('target')} AS target, len(wc)::INTEGER AS length, {R('list_sum(wc)')} AS sum_click,
  {R('wc[1]')} AS oldest_click, {R('we[7]')} AS newest_error FROM win WHERE len(wc) = 7""")
def _(spark, d):
    out = windows(days_of(spark, d), SENS.within("day_id"), ["click", "error"], "view", 7)
    clicks = F.transform("window", lambda r: r[0])
    return out.select(
        "day_id", "slot", rnd("view").alias("target"), F.size("window").alias("length"),
        rnd(F.aggregate(clicks, F.lit(0.0), lambda a, b: a + b)).alias("sum_click"),
        rnd(F.col("window")[0][0]).alias("oldest_click"), rnd(F.col("window")[6][1]).alias("newest_error"))


def days_of(spark, d):
    return day_slots(numbered_working_days(complete_sens(spark, d), SENS, "05:00", "17:30", stage), SENS)


XS = ["click", "error", "purchase"]
SHIFTS = 30


def _corr_sql(circular: bool) -> str:
    pair = ("y.pos = (x.pos + s.shift) % n.n" if circular else "y.pos = x.pos + s.shift")
    return WORK_SQL + f""", n AS (SELECT day_id, count(*) AS n FROM workdays GROUP BY 1),
corrs AS (SELECT x.day_id, s.shift::INTEGER AS shift, """ + ", ".join(f"corr(x.{c}, y.view) AS {c}" for c in XS) + f"""
  FROM workdays x JOIN n USING (day_id) CROSS JOIN range({SHIFTS}) s(shift) JOIN workdays y ON y.day_id = x.day_id AND {pair}
  GROUP BY ALL),
long AS (UNPIVOT corrs ON {", ".join(XS)} INTO NAME signal VALUE corr)"""


@query("w18_lag_correlation", f"WITH {_corr_sql(False)} SELECT day_id, shift, signal, {R('corr')} AS corr FROM long")
def _(spark, d):
    out = lag_corr(days_of(spark, d), SENS, XS, "view", SHIFTS)
    return out.select("day_id", "shift", "signal", rnd("corr").alias("corr"))


@query("w19_circular_correlation", f"WITH {_corr_sql(True)} SELECT day_id, shift, signal, {R('corr')} AS corr FROM long")
def _(spark, d):
    out = lag_corr(days_of(spark, d), SENS, XS, "view", SHIFTS, circular=True)
    return out.select("day_id", "shift", "signal", rnd("corr").alias("corr"))


@query("w20_best_lag", f"""WITH {_corr_sql(True)} SELECT day_id, signal, arg_max(shift, abs(corr) - shift * 1e-12) AS shift,
  {R('arg_max(corr, abs(corr) - shift * 1e-12)')} AS corr FROM long GROUP BY ALL""")
def _(spark, d):
    out = best_lag(lag_corr(days_of(spark, d), SENS, XS, "view", SHIFTS, circular=True), SENS)
    return out.select("day_id", "signal", "shift", rnd("corr").alias("corr"))


@query("a21_mean_correlation", f"WITH {_corr_sql(False)} SELECT shift, signal, {R('avg(corr)')} AS corr FROM long GROUP BY ALL")
def _(spark, d):
    out = mean_over_days(lag_corr(days_of(spark, d), SENS, XS, "view", SHIFTS), ["shift", "signal"], ["corr"])
    return out.select("shift", "signal", rnd("corr").alias("corr"))


@query("a21_mean_profile", f"WITH {WORK_SQL} SELECT pos AS slot, {R('avg(view)')} AS view, {R('avg(click)')} AS click FROM workdays GROUP BY 1")
def _(spark, d):
    out = mean_over_days(days_of(spark, d), ["slot"], ["view", "click"])
    return out.select("slot", rnd("view").alias("view"), rnd("click").alias("click"))


RATE = 1.0 / 600
MAX_HZ = 0.0004
_FREQ_SQL = WORK_SQL + f""", n AS (SELECT day_id, count(*) AS n FROM workdays GROUP BY 1),
sig AS (UNPIVOT (SELECT day_id, pos, click, view FROM workdays) ON click, view INTO NAME signal VALUE x),
bins AS (SELECT day_id, n, unnest(range(n // 2)) AS k FROM n),
spec AS (SELECT s.day_id, s.signal, b.k::INTEGER AS k, b.k * {RATE!r} / b.n AS freq,
  CASE WHEN b.k = 0 THEN 0.0 ELSE sqrt(pow(sum(x * cos(2 * pi() * b.k * s.pos / b.n)), 2) + pow(sum(x * sin(2 * pi() * b.k * s.pos / b.n)), 2)) END AS mag
  FROM sig s JOIN bins b USING (day_id) WHERE b.k * {RATE!r} / b.n < {MAX_HZ!r} GROUP BY s.day_id, s.signal, b.k, b.n)"""


def _spec(spark, d):
    return spectrum(days_of(spark, d), SENS, ["click", "view"], RATE, MAX_HZ)


@query("w21_amplitude_spectrum", f"WITH {_FREQ_SQL} SELECT day_id, signal, k, {R('freq', 9)} AS freq, {R('mag')} AS mag FROM spec")
def _(spark, d):
    return _spec(spark, d).select("day_id", "signal", "k", rnd("freq", 9).alias("freq"), rnd("mag").alias("mag"))


@query("w22_period_hours", f"""WITH {_FREQ_SQL} SELECT day_id, signal, k,
  {R('CASE WHEN freq <> 0 THEN 1 / freq / 3600 END')} AS period_h, {R('mag')} AS mag FROM spec""")
def _(spark, d):
    return _spec(spark, d).select("day_id", "signal", "k", rnd(period_hours(F.col("freq"))).alias("period_h"),
                                  rnd("mag").alias("mag"))


@query("a21_mean_spectrum", f"WITH {_FREQ_SQL} SELECT signal, k, {R('avg(mag)')} AS mag FROM spec GROUP BY ALL")
def _(spark, d):
    return mean_over_days(_spec(spark, d), ["signal", "k"], ["mag"]).select("signal", "k", rnd("mag").alias("mag"))


@query("w23_elapsed_time", f"""WITH {WORK_SQL} SELECT day_id, pos AS slot, {R('pos * 10.0')} AS minutes,
  {R('pos * 10.0 / 60')} AS hours, {R('pos * 10.0 / 60 / 24', 6)} AS days FROM workdays""")
def _(spark, d):
    e = elapsed(F.col("slot"), 10.0)
    return days_of(spark, d).select("day_id", "slot", rnd(e["minutes"]).alias("minutes"),
                                    rnd(e["hours"]).alias("hours"), rnd(e["days"], 6).alias("days"))


@query("w24_day_table", f"WITH {WORK_SQL} SELECT day_id, pos AS slot, {R('view')} AS view, {R('click')} AS click FROM workdays")
def _(spark, d):
    return days_of(spark, d).select("day_id", "slot", rnd("view").alias("view"), rnd("click").alias("click"))


@query("e4_day_report_mean_correlation", f"WITH {_corr_sql(True)} SELECT shift, signal, {R('avg(corr)')} AS corr FROM long GROUP BY ALL")
def _(spark, d):
    report = day_report(complete_sens(spark, d), SENS, XS, "view", start="05:00", end="17:30", max_shift=SHIFTS,
                        rate_hz=RATE, max_hz=MAX_HZ, circular=True)
    return report["mean_corr"].select("shift", "signal", rnd("corr").alias("corr"))
