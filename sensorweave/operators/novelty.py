"""Novelty against a fitted map."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.operators.assign import assign, distances, hit_map, nearest
from sensorweave.operators.codebook import Codebook
from sensorweave.operators.sketch import bit_sketch, common_types, with_maybe
from sensorweave.sources.stage import stage
from sensorweave.spec import from_micros


def allowed_nodes(codebook: Codebook, counted: DataFrame, min_hits: int) -> Codebook:
    """The neurons with at least ``min_hits`` rows in ``counted`` (runs a job that returns the map)."""
    spark = counted.sparkSession
    hits = {r.bmu: r.hits for r in hit_map(counted, codebook.table(spark)).select("bmu", "hits").collect()}
    keep = [i for i in range(codebook.size) if hits[i] >= min_hits]
    if len(keep) < 2:
        raise ValueError("fewer than two neurons have enough rows")
    return Codebook(codebook.weights[keep], 1, len(keep))


def knn_novelty(df: DataFrame, codebook: Codebook, features: str = "features", k: int = 3, min_hits: int = 1,
                count_on: DataFrame | None = None, out: str = "knn") -> DataFrame:
    """Mean distance to the ``k`` nearest neurons that hold rows (N17); higher is more novel.

    Rows are counted on ``df`` itself, or on ``count_on`` (training rows) if given.
    """
    counted = assign(df if count_on is None else count_on, codebook, features)
    return knn_score(df, allowed_nodes(codebook, counted, min_hits), features, k, out)


def knn_score(df: DataFrame, nodes: Codebook, features: str, k: int, out: str = "knn") -> DataFrame:
    """Mean distance of each row, arriving or stored, to the ``k`` nearest of ``nodes``."""
    if nodes.size < k:
        raise ValueError(f"{k} neighbours asked for, {nodes.size} neurons allowed")
    if k == 1:
        near = assign(df, nodes, features)
        return near.withColumn(out, F.col("dmin")).drop("bmu", "dmin", "row", "col")
    near = assign(df, nodes, features, k)
    mean = F.aggregate("dists", F.lit(0.0), lambda s, v: s + v) / k
    return near.withColumn(out, mean).drop("bmus", "dists")


def qe_score(dist: Column, mean_dist: Column, dmax: Column) -> Column:
    """Degree of normality in [0, 1] (N19): 1 up to the training mean, 0 beyond ``dmax``, linear between.

    Beyond ``dmax`` wins over "up to the mean", so a neuron with a small ``dmax`` can reject a row the
    mean would accept. Without ``dmax`` (unhit neuron) only the mean decides.
    """
    between = 1 - (dist - mean_dist) / (dmax - mean_dist)
    return (F.when(dist > dmax, 0.0).when(dist <= mean_dist, 1.0)
            .when(dist < dmax, between).otherwise(0.0))


def training_stats(train: DataFrame, codebook: Codebook, method: str = "worst", features: str = "features") -> DataFrame:
    """Per neuron the training mean distance and ``dmax`` (N18): one row per neuron.

    ``worst``: the largest distance of all rows for every neuron; ``by_bmu``: of the neuron's rows; ``both``: the
    latter, and the former as ``worst``.
    """
    hits = assign(train, codebook, features)
    # one pass over the rows: the neurons' sums, one row each, give the overall figures as well
    own = hits.groupBy("bmu").agg(F.sum("dmin").alias("_s"), F.count("dmin").alias("_n"), F.max("dmin").alias("_own"))
    everywhere = Window.partitionBy()
    maps = codebook.table(train.sparkSession).select("bmu").join(own, "bmu", "left").select(
        "bmu", (F.sum("_s").over(everywhere) / F.sum("_n").over(everywhere)).alias("mean_dist"), "_own",
        F.max("_own").over(everywhere).alias("_worst"))
    if method not in ("worst", "by_bmu", "both"):
        raise ValueError(f"unknown method {method}")
    maps = maps.withColumn("dmax", F.col("_worst") if method == "worst" else F.col("_own"))
    return maps.select("bmu", "mean_dist", "dmax", *([F.col("_worst").alias("worst")] if method == "both" else []))


def qe_novelty(test: DataFrame, stats: DataFrame, codebook: Codebook, features: str = "features",
               fiability: float = 1.0, out: str = "nd") -> DataFrame:
    """Score rows against a fitted map and its training statistics (N19); ``fiability`` scales ``dmax``."""
    hits = assign(test, codebook, features).join(F.broadcast(stats), "bmu", "left")  # one row per neuron
    score = qe_score(F.col("dmin"), F.col("mean_dist"), F.col("dmax") * fiability)
    return hits.withColumn(out, score).drop("mean_dist", "dmax", "row", "col")


def compare_scores(a: DataFrame, b: DataFrame, row_key: str, x: str, y: str, x_cut: float, y_cut: float) -> DataFrame:
    """Agreement of two novelty scores (N20): 2 x 2 counts of "below the cut" plus the correlation."""
    both = a.select(row_key, x).join(b.select(row_key, y), row_key)
    below_x, below_y = (F.col(x) < x_cut).cast("long"), (F.col(y) < y_cut).cast("long")
    return both.agg(
        F.sum(below_x * below_y).alias("both"), F.sum(below_x * (1 - below_y)).alias("only_x"),
        F.sum((1 - below_x) * below_y).alias("only_y"), F.sum((1 - below_x) * (1 - below_y)).alias("neither"),
        F.corr(x, y).alias("corr"))


#: Most pivots of an index (each a row on the driver and in every task), and rows that one comparison takes from either side.
PIVOTS, ROWS, QUERIES = 1024, 16_384, 4096
_SLACK = 1e-8


def _points(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(c)) for c in cols])


@dataclass(frozen=True)
class PivotIndex:
    """Distinct history rows in Voronoi cells around pivots.

    ``rows``: ``_cell``, ``_t`` (earliest time of the row, in microseconds) and ``cols``. ``pivots``, ``radius`` (largest distance
    of a cell's rows from its pivot) and ``count`` have one entry per cell."""

    rows: DataFrame
    cols: tuple[str, ...]
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    def reachable(self, x: np.ndarray, own: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Which cells may hold a row at most ``best`` away from each point, by the triangle inequality.

        A row of a cell is no closer than the pivot less the radius, nor than half the difference between the
        distances to the cell's pivot and to the point's own.
        """
        d = distances(x, self.pivots)
        near = np.take_along_axis(d, own[:, None], axis=1)
        bound = np.maximum(d - self.radius[None, :], (d - near) / 2)
        ok = (bound <= (best + _SLACK * (1 + best))[:, None]) & (self.count > 0)[None, :]
        ok[np.arange(len(x)), own] = False
        return ok


def pivot_index(history: DataFrame, cols: Sequence[str], ts: str, pivots: int | None = None) -> PivotIndex:
    """Cut a history into cells. Equal rows become one with their earliest time; rows with a null are left out.

    The pivots are distinct rows picked by hash, about the square root of their number and ``PIVOTS`` at most: any pivots
    give the same neighbours. Only the pivots and one row of facts per cell reach the driver.
    """
    cols = list(cols)
    number = [F.col(c).cast("double").alias(c) for c in cols]
    given = history.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), *number).dropna(subset=["_t", *cols])
    # -0.0 and 0.0 are one value to a group, so the time is the earliest of both
    rows = stage(given.groupBy(*cols).agg(F.min("_t").alias("_t")), "nearest-rows")
    n = rows.count()
    wanted = pivots or int(min(PIVOTS, max(1, round(n ** 0.5))))
    picked = rows.orderBy(F.xxhash64(*cols), *cols).limit(wanted).select(*cols).toArrow()
    points = np.column_stack([picked[c].to_numpy() for c in cols]) if n else np.zeros((0, len(cols)))

    def run(batches):
        for b in batches:
            if b.num_rows:
                at, far = nearest(_points(b, cols), points, 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at[:, 0].astype(np.int32)), pa.array(far[:, 0])],
                                                 names=[*b.schema.names, "_cell", "_far"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())])
    celled = stage(rows.mapInArrow(run, schema), "nearest-cells")
    facts = celled.groupBy("_cell").agg(F.max("_far").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # one row per pivot
    radius, count = np.zeros(len(points)), np.zeros(len(points), np.int64)
    for f in facts:
        radius[f["_cell"]], count[f["_cell"]] = f["r"], f["n"]
    return PivotIndex(celled.drop("_far"), tuple(cols), points, radius, count)


def _best_in_cells(index: PivotIndex, asked: DataFrame, batch: int, digits: int | None) -> DataFrame:
    """Best row per query ``_q`` over the cells it is routed to: ``_q, dist, _t``.

    A cell's rows and its queries are cut into blocks of bounded size, and each pair of blocks is one group.
    """
    cols = list(index.cols)
    spark = asked.sparkSession
    per_cell = asked.groupBy("_cell").agg(F.count(F.lit(1)).alias("_k")).withColumn("_qb", F.ceil(F.col("_k") / batch).cast("int")).drop("_k")
    blocks = spark.createDataFrame([(i, max(1, -(-int(c) // ROWS))) for i, c in enumerate(index.count)], "_cell int, _hb int")  # per pivot
    cuts = F.broadcast(blocks.join(per_cell, "_cell"))  # one row per pivot at most
    part = lambda of, parts: F.pmod(F.xxhash64(*of), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = asked.join(cuts, "_cell").select("_q", *cols, "_cell", part(["_q"], "_qb").alias("_b"), every("_hb").alias("_a"))
    right = index.rows.join(cuts, "_cell").select("_t", *cols, "_cell", part(["_t", *cols], "_hb").alias("_a"), every("_qb").alias("_b"))

    def compare(q: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(h):
            return pd.DataFrame({"_q": np.zeros(0, np.int64), "dist": np.zeros(0), "_t": np.zeros(0, np.int64)})
        x, rows, t = q[cols].to_numpy(float), h[cols].to_numpy(float), h["_t"].to_numpy(np.int64)
        best, when = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for a in range(0, len(rows), 512):
            d = distances(x, rows[a:a + 512])
            low = d.min(axis=1)
            seen = d if digits is None else np.round(d, digits)
            lowest = seen.min(axis=1)
            first = np.where(seen == lowest[:, None], t[None, a:a + 512], np.iinfo(np.int64).max).min(axis=1)
            own = best if digits is None else np.round(best, digits)
            better = (lowest < own) | ((lowest == own) & (first < when))
            best, when = np.minimum(best, low), np.where(better, first, when)
        return pd.DataFrame({"_q": q["_q"].to_numpy(), "dist": best, "_t": when})

    keys = ["_cell", "_a", "_b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "_q long, dist double, _t long")


def _lowest(parts: DataFrame, digits: int | None) -> DataFrame:
    seen = F.col("dist") if digits is None else F.round("dist", digits)
    return parts.groupBy("_q").agg(F.min("dist").alias("dist"), F.min(F.struct(seen.alias("d"), F.col("_t").alias("t")))["t"].alias("_t"))


def nearest_record(history: DataFrame, queries: DataFrame, cols: Sequence[str], ts: str, query_key: str,
                   batch: int = QUERIES, digits: int | None = None, index: PivotIndex | None = None) -> DataFrame:
    """The closest historical row to each query row (J4, T2): ``query_key``, ``match_ts``, ``dist``; ties to the earliest time.

    Distances that agree to ``digits`` decimals count as ties. A query is compared with the rows of its own cell of a
    pivot index, then with those cells alone that the distance found so far does not rule out, so most of a
    clustered history is never touched; the result is exact. Queries, history and pairs stay on the
    executors, in blocks of bounded size (``batch`` queries). Queries with a null in ``cols``, and all if the history is empty, have no row.
    """
    cols = list(cols)
    index = index or pivot_index(history, cols, ts)
    asked = stage(queries.select(F.monotonically_increasing_id().alias("_q"), F.col(query_key).alias("_key"),
                                 *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols), "nearest-queries")
    points, shape = index.pivots, "_q long, " + ", ".join(f"`{c}` double" for c in cols) + ", _cell int"
    if not len(points):
        return asked.limit(0).select(F.col("_key").alias(query_key), F.lit(None).cast("timestamp_ntz").alias("match_ts"),
                                     F.lit(0.0).alias("dist"))

    def home(batches):
        for b in batches:
            if b.num_rows:
                at = nearest(_points(b, cols), points, 1)[0][:, 0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "_cell"])

    def others(batches):
        for b in batches:
            if b.num_rows:
                x = _points(b, cols)
                row, cell = np.nonzero(index_facts.reachable(x, np.asarray(b.column("_own")), np.asarray(b.column("_best"))))
                yield pa.RecordBatch.from_arrays([b.column("_q").take(pa.array(row)), *[b.column(c).take(pa.array(row)) for c in cols],
                                                  pa.array(cell.astype(np.int32))], names=["_q", *cols, "_cell"])

    index_facts = replace(index, rows=None)  # what goes along with the tasks
    routed = stage(asked.drop("_key").mapInArrow(home, shape), "nearest-home")
    first = stage(_best_in_cells(index, routed, batch, digits), "nearest-first")
    bound = first.groupBy("_q").agg(F.min("dist").alias("_best"))
    open_ = routed.withColumnRenamed("_cell", "_own").join(bound, "_q")
    second = _best_in_cells(index, stage(open_.mapInArrow(others, shape), "nearest-routes"), batch, digits)
    best = _lowest(first.unionByName(second), digits)
    return asked.select("_q", "_key").join(best, "_q").select(
        F.col("_key").alias(query_key), from_micros(F.col("_t")).alias("match_ts"), "dist")


def matched_days(history: DataFrame, ts: str, matches: DataFrame) -> DataFrame:
    """All history rows on the calendar day of a match."""
    days = matches.select(F.to_date("match_ts").alias("_day")).distinct()
    return history.withColumn("_day", F.to_date(ts)).join(days, "_day", "left_semi").drop("_day")


def day_context(history: DataFrame, ts: str, matches: DataFrame, query_key: str) -> DataFrame:
    """The history rows on the day of each match, for every match (J5, N31): the history's columns, ``query_key``, ``match_ts``."""
    days = matches.select(query_key, "match_ts", F.to_date("match_ts").alias("_day"))
    return history.withColumn("_day", F.to_date(ts)).join(days, "_day").drop("_day")


def shared_rows(a: DataFrame, b: DataFrame, cols: Sequence[str], keep: bool = True, hot_share: float = 1e-3,
                sketch_bits: int = 24) -> DataFrame:
    """Rows of ``a`` that have (or have no) identical row in ``b``, nulls equal.

    A Bloom filter over ``b`` of ``2 ** sketch_bits`` bits, made by partial aggregates, settles most rows of ``a`` that ``b``
    does not have where they lie; beyond some millions of tuples it fills up and lets more rows through, with the
    same result. A tuple that fills more than ``hot_share`` of ``a`` is tested once and its answer sent to all tasks,
    where its rows stay; at most 1 / ``hot_share`` tuples can. The others meet ``b``'s distinct tuples in a join, in
    which none is frequent.
    """
    types = common_types(a, b, cols)
    values = [F.col(c).cast(t) for c, t in types.items()]
    tuples = F.struct(*[v.alias(c) for v, c in zip(values, types)])
    right = b.select(tuples.alias("_tuple")).distinct()
    sketch = stage(bit_sketch(b, values, sketch_bits), "tuple-sketch")
    left = with_maybe(a, sketch, values, sketch_bits).withColumn("_tuple", tuples)
    limit = a.count() * hot_share
    hot = left.where("_maybe").groupBy("_tuple").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("_tuple", F.lit(True).alias("_hot"))
    known = hot.join(right.withColumn("_in", F.lit(True)), "_tuple", "left")
    marked = left.join(F.broadcast(stage(known, "hot-tuples")), "_tuple", "left")
    # settled where they lie: tuples the filter does not hold, and frequent ones
    settled = marked.where("NOT _maybe OR _hot").where(F.col("_in").isNotNull() if keep else F.col("_in").isNull())
    rare = marked.where("_maybe AND _hot IS NULL").join(right, "_tuple", "left_semi" if keep else "left_anti")
    return settled.select(*a.columns).unionByName(rare.select(*a.columns))


def detection_share(detected: DataFrame, outliers: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of detected rows that are planted outliers."""
    tagged = outliers.select(*cols).distinct().withColumn("_hit", F.lit(1.0))
    joined = detected.select(*cols).join(tagged, list(cols), "left")
    return joined.agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("share"))

