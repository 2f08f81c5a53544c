"""Projections, filters, calendar, resampling."""

import datetime as dt

from pyspark.sql import functions as F

from sensorweave.catalog.base import (
    COMPLETE_SQL, DENSE_SQL, EV, EV1, R, SEG, SEGMENTED_SQL, SENS, SENSORS, complete_sens, dense_sens,
    events, query, rnd, segmented, table,
)
from sensorweave.operators.calendar import (
    between_time, calendar_parts, drop_days, mean_by, month_weekday_matrix, nth_day, number_days,
    resample_aggregates, resample_days, resample_months, time_range, weekday_blocks, weekdays_only,
    working_days,
)
from sensorweave.operators.diagnostics import context_rows, gap_histogram
from sensorweave.operators.features import clock_features
from sensorweave.operators.segments import resample

_ROUNDED = ", ".join(f"{R(s)} AS {s}" for s in SENSORS)


def rounded(cols=SENSORS):
    return [rnd(c).alias(c) for c in cols]


@query("p1_select_columns", f"WITH {SEGMENTED_SQL} SELECT segment_id, ts, {R('view')} AS view, {R('click')} AS click FROM seg")
def _(spark, d):
    return segmented(spark, d).select("segment_id", "ts", rnd("view").alias("view"), rnd("click").alias("click"))


@query("p2_drop_columns", "SELECT event_id, ts, event_type, value FROM events")
def _(spark, d):
    return events(spark, d).drop("user_id")


@query("p3_rename_column", "SELECT event_id, ts AS datetime, value AS reading FROM events")
def _(spark, d):
    return (events(spark, d).select("event_id", "ts", "value")
            .withColumnRenamed("ts", "datetime").withColumnRenamed("value", "reading"))


@query("p4_time_range", "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' "
       "AND ts < TIMESTAMP '2024-01-06 12:01:00'")
def _(spark, d):
    return time_range(events(spark, d), EV1, dt.datetime(2024, 1, 5, 12), dt.datetime(2024, 1, 6, 12)).select(
        "event_id", "ts", "value")


@query("p5_remove_days", "SELECT event_id, ts FROM events WHERE ts::DATE NOT IN (DATE '2024-01-10', DATE '2023-01-01')")
def _(spark, d):
    return drop_days(events(spark, d), EV1, [dt.date(2024, 1, 10), dt.date(2023, 1, 1)]).select("event_id", "ts")


@query("p6_between_time", "SELECT event_id, ts FROM events WHERE ts::TIME BETWEEN TIME '04:32:00' AND TIME '18:30:00'")
def _(spark, d):
    return between_time(events(spark, d), EV1, "04:32", "18:30").select("event_id", "ts")


@query("p7_weekdays", "SELECT event_id, ts FROM events WHERE isodow(ts) <= 5")
def _(spark, d):
    return weekdays_only(events(spark, d), EV1).select("event_id", "ts")


@query("p8_weekday_blocks", """
WITH f AS (SELECT event_id, event_type, ts, isodow(ts) <= 5 AS w FROM events),
c AS (SELECT *, CASE WHEN w AND NOT coalesce(lag(w) OVER (PARTITION BY event_type ORDER BY ts, event_id), false)
  THEN 1 ELSE 0 END AS o FROM f)
SELECT event_id, block_id FROM (SELECT event_id, w, sum(o) OVER (PARTITION BY event_type ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS block_id FROM c) WHERE w""")
def _(spark, d):
    return weekday_blocks(events(spark, d), EV).select("event_id", "block_id")


WORK_SQL = COMPLETE_SQL + """,
hours AS (SELECT * FROM full_sens WHERE ts::TIME BETWEEN TIME '05:00:00' AND TIME '17:30:00' AND isodow(ts) <= 5),
sizes AS (SELECT ts::DATE AS d, count(*) AS n FROM hours GROUP BY 1),
work AS (SELECT h.* FROM hours h JOIN sizes s ON h.ts::DATE = s.d WHERE s.n = (SELECT max(n) FROM sizes)),
workdays AS (SELECT *, (dense_rank() OVER (ORDER BY ts::DATE) - 1)::INTEGER AS day_id,
  row_number() OVER (PARTITION BY ts::DATE ORDER BY ts) - 1 AS pos FROM work)"""


def work(spark, d):
    return working_days(complete_sens(spark, d), SENS, "05:00", "17:30")


@query("p9_working_days", f"WITH {WORK_SQL} SELECT slot, ts, {_ROUNDED} FROM work")
def _(spark, d):
    return work(spark, d).select("slot", "ts", *rounded())


@query("w14_number_days", f"WITH {WORK_SQL} SELECT slot, ts, day_id FROM workdays")
def _(spark, d):
    return number_days(work(spark, d), SENS).select("slot", "ts", "day_id")


@query("t4_last_day", f"WITH {WORK_SQL} SELECT slot, ts, day_id FROM workdays WHERE day_id = (SELECT max(day_id) FROM workdays)")
def _(spark, d):
    return nth_day(number_days(work(spark, d), SENS), SENS, -1).select("slot", "ts", "day_id")


@query("t4_nth_day", f"WITH {WORK_SQL} SELECT slot, ts, day_id FROM workdays WHERE day_id = 2")
def _(spark, d):
    return nth_day(number_days(work(spark, d), SENS), SENS, 2).select("slot", "ts", "day_id")


@query("p10_every_kth_row", f"WITH {DENSE_SQL} SELECT slot, ts, {R('view')} AS view FROM dense WHERE slot % 3 = 1")
def _(spark, d):
    return dense_sens(spark, d).where("slot % 3 = 1").select("slot", "ts", rnd("view").alias("view"))


@query("p11_trim_rows", f"WITH {SEGMENTED_SQL} SELECT segment_id, slot, ts FROM (SELECT *, count(*) OVER "
       "(PARTITION BY segment_id) AS n FROM seg) WHERE slot >= 2 AND slot < n - 3")
def _(spark, d):
    from sensorweave.operators.features import lead_target

    kept = lead_target(segmented(spark, d).withColumn("_s", F.col("slot")), SEG, "_s", 3, "_t")
    return kept.where("slot >= 2").select("segment_id", "slot", "ts")


@query("p12_context_rows", """
WITH s AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS slot,
  (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id))) / 60000000.0 AS gap FROM events),
h AS (SELECT slot AS hit FROM s WHERE gap > 25)
SELECT hit AS hit_slot, slot, event_id FROM s JOIN h ON slot >= hit - 3 AND slot < hit + 3""")
def _(spark, d):
    return context_rows(events(spark, d), EV1, 25.0, 3).select("hit_slot", "slot", "event_id")


@query("p14_fold_predicate", f"WITH {WORK_SQL} SELECT slot, day_id, day_id = 1 AS is_test FROM workdays")
def _(spark, d):
    return number_days(work(spark, d), SENS).select("slot", "day_id", (F.col("day_id") == 1).alias("is_test"))


@query("a1_mean_by_hour", f"SELECT hour(ts)::INTEGER AS hour, {R('avg(value)')} AS mean FROM events GROUP BY 1")
def _(spark, d):
    out = mean_by(events(spark, d), {"hour": F.hour("ts")}, "value")
    return out.select("hour", rnd("mean").alias("mean"))


@query("a1_mean_by_weekday", f"SELECT (isodow(ts) - 1)::INTEGER AS dayofweek, {R('avg(value)')} AS mean FROM events GROUP BY 1")
def _(spark, d):
    out = mean_by(events(spark, d), {"dayofweek": F.weekday("ts")}, "value")
    return out.select("dayofweek", rnd("mean").alias("mean"))


@query("a2_mean_by_month_weekday", f"""SELECT month(o_orderdate)::INTEGER AS month, (isodow(o_orderdate) - 1)::INTEGER AS dayofweek,
  {R('avg(o_totalprice)', 2)} AS mean FROM orders GROUP BY 1, 2""")
def _(spark, d):
    out = mean_by(table(spark, d, "orders"), {"month": F.month("o_orderdate"), "dayofweek": F.weekday("o_orderdate")},
                  "o_totalprice")
    return out.select("month", "dayofweek", rnd("mean", 2).alias("mean"))


@query("a3_month_weekday_matrix", "SELECT month(o_orderdate)::INTEGER AS month, " + ", ".join(
    R(f"avg(o_totalprice) FILTER (WHERE isodow(o_orderdate) = {i + 1})", 2) + f" AS d{i}" for i in range(7))
       + " FROM orders GROUP BY 1")
def _(spark, d):
    from sensorweave.catalog.base import EV1 as spec
    from dataclasses import replace

    out = month_weekday_matrix(table(spark, d, "orders"), replace(spec, ts="o_orderdate"), "o_totalprice")
    return out.select("month", *[rnd(f"d{i}", 2).alias(f"d{i}") for i in range(7)])


@query("a4_resample_grid", f"WITH {DENSE_SQL} SELECT slot, ts, {_ROUNDED} FROM dense")
def _(spark, d):
    return dense_sens(spark, d).select("slot", "ts", *rounded())


@query("a4_resample_per_key", f"""
WITH b AS (SELECT event_type, epoch_us(ts) // 3600000000 AS bin, avg(value) AS v, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT event_type, min(bin) AS lo, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY 1)
SELECT event_type, g.bin - lo AS slot, make_timestamp(g.bin * 3600000000) AS ts, {R('v')} AS v, n FROM g
LEFT JOIN b USING (event_type, bin)""")
def _(spark, d):
    out = resample(events(spark, d), EV, 3600, {"v": F.avg("value"), "n": F.count(F.lit(1))})
    return out.select("event_type", "slot", "ts", rnd("v").alias("v"), "n")


@query("a5_resample_days", f"""
WITH s AS (SELECT event_type, min(ts)::DATE AS f, max(ts)::DATE AS t FROM events GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(f::TIMESTAMP, t::TIMESTAMP, INTERVAL 3 DAY))::DATE AS bin FROM s),
a AS (SELECT event_type, (f + ((ts::DATE - f) // 3 * 3)::INTEGER)::DATE AS bin, avg(value) AS v
  FROM events JOIN s USING (event_type) GROUP BY ALL)
SELECT event_type, bin, {R('v')} AS mean FROM g LEFT JOIN a USING (event_type, bin)""")
def _(spark, d):
    out = resample_days(events(spark, d), EV, 3, {"mean": F.avg("value")})
    return out.select("event_type", "bin", rnd("mean").alias("mean"))


@query("a6_resample_months", f"""
WITH g AS (SELECT last_day(unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH))::DATE)
  AS month_end FROM orders),
a AS (SELECT last_day(o_orderdate::DATE) AS month_end, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT month_end, {R('v', 2)} AS mean, n FROM g LEFT JOIN a USING (month_end)""")
def _(spark, d):
    from dataclasses import replace

    out = resample_months(table(spark, d, "orders"), replace(EV1, ts="o_orderdate"),
                          {"mean": F.avg("o_totalprice"), "n": F.count(F.lit(1))})
    return out.select("month_end", rnd("mean", 2).alias("mean"), "n")


_A7 = ["sum", "mean", "std", "sem", "max", "min", "first", "last", "open", "high", "low", "close"]


@query("a7_bin_aggregates", f"""
SELECT event_type, epoch_us(ts) // 21600000000 AS bin, {R('sum(value)')} AS sum, {R('avg(value)')} AS mean,
  {R('stddev_samp(value)')} AS std, {R('stddev_samp(value) / sqrt(count(value))')} AS sem,
  {R('max(value)')} AS max, {R('min(value)')} AS min, {R('arg_min(value, ts)')} AS first, {R('arg_max(value, ts)')} AS last,
  {R('arg_min(value, ts)')} AS open, {R('max(value)')} AS high, {R('min(value)')} AS low, {R('arg_max(value, ts)')} AS close
FROM events GROUP BY ALL""")
def _(spark, d):
    df = events(spark, d).withColumn("bin", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000))
    aggs = resample_aggregates("value", "ts")
    return df.groupBy("event_type", "bin").agg(*[rnd(c).alias(n) for n, c in aggs.items()])


@query("a7_bin_median", f"SELECT event_type, ts::DATE AS d, {R('median(value)')} AS med FROM events GROUP BY ALL")
def _(spark, d):
    from sensorweave.operators.quantiles import exact_quantiles

    df = events(spark, d).withColumn("d", F.to_date("ts"))
    out = exact_quantiles(df, "value", [0.5], ["event_type", "d"])
    return out.select("event_type", "d", rnd("q").alias("med"))


@query("a10_gap_histogram", """
WITH g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) // 60000000 AS gap_min,
  event_type FROM events)
SELECT event_type, gap_min, count(*) AS n FROM g WHERE gap_min IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return gap_histogram(events(spark, d), EV)


@query("f1_difference", f"WITH {DENSE_SQL} SELECT slot, {R('view - click')} AS diff FROM dense")
def _(spark, d):
    return dense_sens(spark, d).select("slot", rnd(F.col("view") - F.col("click")).alias("diff"))


@query("f2_calendar_parts", """SELECT event_id, day(ts)::INTEGER AS day, (isodow(ts) - 1)::INTEGER AS dayofweek,
  month(ts)::INTEGER AS month, hour(ts)::INTEGER AS hour, minute(ts)::INTEGER AS minute FROM events""")
def _(spark, d):
    return events(spark, d).select("event_id", *[c.alias(n) for n, c in calendar_parts("ts").items()])


@query("f3_f4_cyclic_clock", f"""SELECT event_id, {R('sin(2 * pi() * hour(ts) / 24.0)', 6)} AS hours_sin,
  {R('cos(2 * pi() * hour(ts) / 24.0)', 6)} AS hours_cos, {R('sin(2 * pi() * (isodow(ts) - 1) / 7.0)', 6)} AS day_week_sin,
  {R('cos(2 * pi() * (isodow(ts) - 1) / 7.0)', 6)} AS day_week_cos FROM events""")
def _(spark, d):
    return events(spark, d).select("event_id", *[rnd(c, 6).alias(n) for n, c in clock_features("ts").items()])


@query("t1_sort", "SELECT event_id, value FROM events ORDER BY value, event_id")
def _(spark, d):
    return events(spark, d).select("event_id", "value").orderBy("value", "event_id")


@query("u1_union_all", """SELECT event_id, event_type, value FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, event_type, value FROM events WHERE event_type <> 'view' AND value > 10""")
def _(spark, d):
    df = events(spark, d).select("event_id", "event_type", "value")
    return df.where("event_type = 'view'").unionByName(df.where("event_type <> 'view' AND value > 10"))


@query("u2_tagged_union", """SELECT event_id, value, 'high' AS src FROM events WHERE value > 20
UNION ALL SELECT event_id, value, 'low' AS src FROM events WHERE value < 1""")
def _(spark, d):
    df = events(spark, d).select("event_id", "value")
    return (df.where("value > 20").withColumn("src", F.lit("high"))
            .unionByName(df.where("value < 1").withColumn("src", F.lit("low"))))


@query("u3_distinct", "SELECT DISTINCT event_type, user_id FROM events")
def _(spark, d):
    return events(spark, d).select("event_type", "user_id").distinct()
