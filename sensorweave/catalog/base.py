"""Shared pieces of the registered queries: the registry, input tables, rounding, SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorweave.spec import MICROS, SeriesSpec, configure, from_micros, micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can say the same thing, its DuckDB counterpart."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(value: Column | str, digits: int = 4) -> Column:
    """Round for comparison; the shift keeps exact half-way decimals off the rounding edge."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + 10.0 ** -(digits + 3), digits) + F.lit(0.0)


def R(value: str, digits: int = 4) -> str:
    """The SQL counterpart of ``rnd``."""
    return f"(round(({value}) + 1e-{digits + 3}, {digits}) + 0.0)"


# --- series tables -------------------------------------------------------------------------------

SENSORS = ["click", "error", "purchase", "signup", "view"]
STEP = 600

EV = SeriesSpec(keys=("event_type",), ts="ts", tiebreak=("event_id",))
EV1 = SeriesSpec(keys=(), ts="ts", tiebreak=("event_id",))
SENS = SeriesSpec(keys=(), ts="ts")
SEG = SENS.within("segment_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a raw multi-sensor table: one column per event type, null where it has no reading."""
    df = table(spark, sf_dir, "events")
    return df.select("event_id", "ts", *[
        F.when(F.col("event_type") == s, F.col("value")).alias(s) for s in SENSORS])


def sens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events averaged on a 10-minute grid, one column per event type; empty slots have no row."""
    df = wide_events(spark, sf_dir)
    bin_ = F.floor(micros("ts") / (STEP * MICROS))
    return (
        df.groupBy(bin_.alias("slot")).agg(*[F.avg(s).alias(s) for s in SENSORS])
        .withColumn("ts", from_micros(F.col("slot") * (STEP * MICROS)))
    )


SENS_SQL = (
    "sens AS (SELECT epoch_us(ts) // 600000000 AS slot, "
    + ", ".join(f"avg(value) FILTER (WHERE event_type = '{s}') AS {s}" for s in SENSORS)
    + ", make_timestamp((epoch_us(ts) // 600000000) * 600000000) AS ts FROM events GROUP BY ALL)"
)


def dense_sens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SENS on every slot between the first and the last event; slot counted from the first."""
    from sensorweave.operators.segments import resample

    return resample(wide_events(spark, sf_dir), SENS, STEP, {s: F.avg(s) for s in SENSORS})


DENSE_SQL = SENS_SQL + (
    ", dense AS (SELECT g.b - (SELECT min(slot) FROM sens) AS slot, make_timestamp(g.b * 600000000) AS ts, "
    + ", ".join(SENSORS)
    + " FROM (SELECT unnest(range(min(slot), max(slot) + 1)) AS b FROM sens) g "
      "LEFT JOIN sens s ON s.slot = g.b)"
)


def fill0(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0.0))


def complete_sens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DENSE with nulls as 0, for operators that want complete signals."""
    df = dense_sens(spark, sf_dir)
    return df.select("slot", "ts", *[fill0(s).alias(s) for s in SENSORS])


COMPLETE_SQL = DENSE_SQL + (
    ", full_sens AS (SELECT slot, ts, "
    + ", ".join(f"coalesce({s}, 0.0) AS {s}" for s in SENSORS) + " FROM dense)"
)


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide events on a 10-minute grid inside segments split at gaps over 30 minutes."""
    from sensorweave.operators.segments import grid_segments

    return grid_segments(wide_events(spark, sf_dir), SENS, STEP, 1800, {s: F.avg(s) for s in SENSORS})


SEGMENTED_SQL = SENS_SQL + (
    ", brk AS (SELECT ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) "
    "> 1800000000 THEN 1 ELSE 0 END AS b FROM events), "
    "numbered AS (SELECT ts, sum(b) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS segment_id FROM brk), "
    "bounds AS (SELECT segment_id, epoch_us(min(ts)) // 600000000 AS lo, epoch_us(max(ts)) // 600000000 AS hi "
    "FROM numbered GROUP BY segment_id), "
    "points AS (SELECT segment_id, lo, unnest(range(lo, hi + 1)) AS b FROM bounds), "
    "seg AS (SELECT p.segment_id, p.b - p.lo AS slot, make_timestamp(p.b * 600000000) AS ts, "
    + ", ".join(SENSORS)
    + " FROM points p LEFT JOIN sens s ON s.slot = p.b)"
)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order count and value per day, with a row position."""
    from sensorweave.operators.ordered import add_slot

    df = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return add_slot(df, DAILY, bucket_seconds=366 * 86_400)


DAILY = SeriesSpec(keys=(), ts="d")
DAILY_SQL = (
    "daily AS (SELECT d, n, total, row_number() OVER (ORDER BY d) - 1 AS slot FROM "
    "(SELECT o_orderdate::DATE AS d, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1))"
)

# --- point tables --------------------------------------------------------------------------------

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE_KEY, *LINE)


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


EMB_SQL = "emb AS (SELECT vec_id, embedding::DOUBLE[] AS features, label FROM embeddings)"
CB_SQL = EMB_SQL + (
    ", cells AS (SELECT (vec_id % 25)::INTEGER AS bmu, i, avg(features[i]) AS v FROM emb, range(1, 65) t(i) GROUP BY ALL)"
    ", cb AS (SELECT bmu, (bmu // 5)::INTEGER AS r, (bmu % 5)::INTEGER AS c, list(v ORDER BY i) AS w FROM cells GROUP BY bmu)"
)
NEAR_SQL = CB_SQL + (
    ", pairs AS (SELECT vec_id, features, label, bmu, list_distance(features, w) AS d FROM emb, cb)"
    ", ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, bmu) AS k FROM pairs)"
    ", near AS (SELECT vec_id, label, bmu, d FROM ranked WHERE k = 1)"
)


def code25(spark: SparkSession, sf_dir: str):
    """A fixed 5 x 5 codebook that SQL can build too: the mean vectors of 25 groups of embeddings."""
    from sensorweave.operators.codebook import Codebook

    means = F.array(*[F.avg(F.col("features")[i]) for i in range(64)])
    rows = (emb(spark, sf_dir).groupBy((F.col("vec_id") % 25).alias("bmu")).agg(means.alias("w"))
            .orderBy("bmu").collect())
    return Codebook.from_rows([r.w for r in rows], 5, 5)
