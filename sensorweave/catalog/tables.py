"""Reports, scaling and metrics on whole tables."""

from pyspark.sql import functions as F

from sensorweave.catalog.base import (
    DENSE_SQL, LINE, LINE_KEY, R, SEG, SEGMENTED_SQL, SENSORS, dense_sens, emb, lineitem, query, rnd, segmented, table,
)
from sensorweave.catalog.cleaning import runs_sql
from sensorweave.catalog.maps import _BIN_SQL, _binary
from sensorweave.functions import metrics as M
from sensorweave.functions.scaling import (
    Scaler, fold_stats, hash_split, inverse_standard, leave_one_out, leave_one_out_stats, minmax_given, standard_given,
)
from sensorweave.operators import assign as A
from sensorweave.operators.diagnostics import column_stats, corr_matrix, corr_with, missing_report, segment_report
from sensorweave.sources.csv import detect_time_column

_KEY = ", ".join(LINE_KEY)


def rounded(cols, digits=4):
    return [rnd(c, digits).alias(c) for c in cols]


@query("a9_missing_ratio", "WITH " + DENSE_SQL + ", m AS (SELECT "
       + ", ".join(f"100.0 * avg(({s} IS NULL)::INTEGER) AS {s}" for s in SENSORS)
       + f""" FROM dense) SELECT "column", {R('missing_pct')} AS missing_pct FROM (UNPIVOT m ON {", ".join(SENSORS)}
  INTO NAME "column" VALUE missing_pct) WHERE missing_pct > 0""")
def _(spark, d):
    return missing_report(dense_sens(spark, d), SENSORS).select("column", rnd("missing_pct").alias("missing_pct"))


@query("a11_segment_report", f"""WITH {SEGMENTED_SQL} {runs_sql('seg', 'view IS NULL')}
SELECT segment_id, count(*) AS n_rows, sum(f::BIGINT)::BIGINT AS nulls, coalesce(max(run_len) FILTER (f), 0) AS longest_null_run,
  (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS days FROM sized GROUP BY segment_id""")
def _(spark, d):
    return segment_report(segmented(spark, d), SEG, "view")


@query("a12_column_stats", "WITH l AS (UNPIVOT (SELECT " + ", ".join(LINE) + " FROM lineitem) ON " + ", ".join(LINE)
       + f""" INTO NAME "column" VALUE x) SELECT "column", {R('avg(x)')} AS mean, {R('quantile_cont(x, 0.5)')} AS median,
  {R('stddev_pop(x)')} AS std, {R('min(x)')} AS min, {R('max(x)')} AS max FROM l GROUP BY 1""")
def _(spark, d):
    return column_stats(lineitem(spark, d), LINE).select("column", *rounded(["mean", "median", "std", "min", "max"]))


_PAIRS = [(a, b) for a in LINE for b in LINE]


@query("a17_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'corr({a}, {b})', 6)} AS corr FROM lineitem" for a, b in _PAIRS))
def _(spark, d):
    return corr_matrix(lineitem(spark, d), LINE).select("col_a", "col_b", rnd("corr", 6).alias("corr"))


@query("a18_correlation_with_target", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {R(f'corr({c}, l_extendedprice)', 6)} AS corr FROM lineitem" for c in LINE if c != "l_extendedprice"))
def _(spark, d):
    cols = [c for c in LINE if c != "l_extendedprice"]
    return corr_with(lineitem(spark, d), cols, "l_extendedprice").select("column", rnd("corr", 6).alias("corr"))


# --- scaling -----------------------------------------------------------------------------------------

def _scaled(expr: str) -> str:
    cols = ", ".join(f"{R(expr.format(c=c), 5)} AS {c}" for c in LINE)
    return f"SELECT {_KEY}, {cols} FROM lineitem"


@query("f5_minmax_scale", _scaled("({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem)"))
def _(spark, d):
    df = lineitem(spark, d)
    return Scaler.fit(df, LINE, "minmax").transform(df).select(*LINE_KEY, *rounded(LINE, 5))


@query("f6_standard_scale", _scaled("({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)"))
def _(spark, d):
    df = lineitem(spark, d)
    return Scaler.fit(df, LINE, "standard").transform(df).select(*LINE_KEY, *rounded(LINE, 5))


@query("f7_minmax_given", f"SELECT {_KEY}, {R('(l_quantity - 1) / 49.0 * 2 - 1', 5)} AS q, {R('(l_discount - 0) / 0.1', 5)} AS disc FROM lineitem")
def _(spark, d):
    q = minmax_given(F.col("l_quantity"), min_val=F.lit(1.0), max_val=F.lit(50.0), feature_range=(-1.0, 1.0))
    disc = minmax_given(F.col("l_discount"), min_val=F.lit(0.0), max_val=F.lit(0.1))
    return lineitem(spark, d).select(*LINE_KEY, rnd(q, 5).alias("q"), rnd(disc, 5).alias("disc"))


@query("f8_standard_given", f"SELECT {_KEY}, {R('(l_quantity - 25.5) / 14.4', 5)} AS q FROM lineitem")
def _(spark, d):
    q = standard_given(F.col("l_quantity"), mean=F.lit(25.5), std=F.lit(14.4))
    return lineitem(spark, d).select(*LINE_KEY, rnd(q, 5).alias("q"))


@query("f9_inverse_standard", f"SELECT {_KEY}, {R('l_discount * 14.4 + 25.5', 5)} AS q FROM lineitem")
def _(spark, d):
    q = inverse_standard(F.col("l_discount"), mean=F.lit(25.5), std=F.lit(14.4))
    return lineitem(spark, d).select(*LINE_KEY, rnd(q, 5).alias("q"))


_LOW = "(SELECT least(" + ", ".join(f"min({c})" for c in LINE) + ") FROM lineitem)"
_HIGH = "(SELECT greatest(" + ", ".join(f"max({c})" for c in LINE) + ") FROM lineitem)"


@query("f10_matrix_wide_scale", _scaled("({c} - " + _LOW + ") / (" + _HIGH + " - " + _LOW + ")"))
def _(spark, d):
    df = lineitem(spark, d)
    return Scaler.fit(df, LINE, "minmax", matrix_wide=True).transform(df).select(*LINE_KEY, *rounded(LINE, 5))


_TRAIN = "(SELECT {f}({c}) FROM lineitem WHERE l_orderkey % 5 <> 4)"


@query("f11_fit_train_apply_test", f"SELECT {_KEY}, " + ", ".join(
    R(f"({c} - {_TRAIN.format(f='avg', c=c)}) / {_TRAIN.format(f='stddev_samp', c=c)}", 5) + f" AS {c}" for c in LINE)
       + " FROM lineitem WHERE l_orderkey % 5 = 4")
def _(spark, d):
    df = lineitem(spark, d)
    scaler = Scaler.fit(df.where("l_orderkey % 5 <> 4"), LINE, "standard", ddof=1)
    return scaler.transform(df.where("l_orderkey % 5 = 4")).select(*LINE_KEY, *rounded(LINE, 5))


@query("f12_hash_split", """SELECT vec_id, 100 * ((('0x' || substr(md5('42,' || vec_id), 1, 8))::BIGINT) / 4294967296.0) < 80 AS is_train FROM embeddings""")
def _(spark, d):
    return hash_split(emb(spark, d), ["vec_id"]).select("vec_id", "is_train")


@query("f12_arithmetic_split", "SELECT vec_id, vec_id % 5 <> 4 AS is_train FROM embeddings")
def _(spark, d):
    return emb(spark, d).select("vec_id", (F.col("vec_id") % 5 != 4).alias("is_train"))


_FOLD = "(l_orderkey % 7)::INTEGER"


@query("f14_leave_one_out_folds", f"""SELECT f::INTEGER AS fold, {_FOLD} = f AS is_test, count(*) AS n, {R('avg(l_quantity)')} AS q
  FROM lineitem, range(7) t(f) GROUP BY ALL""")
def _(spark, d):
    df = lineitem(spark, d).withColumn("k", (F.col("l_orderkey") % 7).cast("int"))
    out = leave_one_out_stats(df, "k", ["l_quantity"])
    return out.select(F.col("k").alias("fold"), "is_test", "n", rnd("mean").alias("q"))


@query("f14_copied_folds", f"""SELECT f::INTEGER AS fold, {_FOLD} = f AS is_test, count(*) AS n, {R('avg(l_tax)', 5)} AS q
  FROM lineitem, range(3) t(f) GROUP BY ALL""")
def _(spark, d):
    df = lineitem(spark, d).withColumn("k", (F.col("l_orderkey") % 7).cast("int"))
    out = leave_one_out(df, "k", range(3)).groupBy("fold", "is_test")
    return out.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("l_tax"), 5).alias("q"))


@query("f15_fold_scaling", " UNION ALL ".join(
    f"""SELECT f::INTEGER AS k, '{c}' AS "column", {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std
  FROM lineitem, range(7) t(f) WHERE {_FOLD} <> f GROUP BY f""" for c in LINE))
def _(spark, d):
    df = lineitem(spark, d).withColumn("k", (F.col("l_orderkey") % 7).cast("int"))
    return fold_stats(df, "k", LINE).select("k", "column", rnd("mean").alias("mean"), rnd("std").alias("std"))


# --- metrics: order priority as class, price against a simple rule ------------------------------------

_PRED = "l_quantity * 1500.0"


def _predicted(spark, d):
    return lineitem(spark, d).withColumn("pred", F.col("l_quantity") * 1500.0)


@query("a22_absolute_error", f"""SELECT {R(f'sum(abs(l_extendedprice - {_PRED}))', 1)} AS error_sum,
  {R(f'avg(abs(l_extendedprice - {_PRED}))')} AS error_avg, {R(f'max(abs(l_extendedprice - {_PRED}))')} AS error_max FROM lineitem""")
def _(spark, d):
    out = M.abs_error_summary(_predicted(spark, d), "l_extendedprice", "pred")
    return out.select(rnd("error_sum", 1).alias("error_sum"), rnd("error_avg").alias("error_avg"), rnd("error_max").alias("error_max"))


_E = "(0.05 - l_discount)"


@query("a23_a24_a25_regression_summary", f"""SELECT l_tax, {R(f'avg({_E} * {_E})', 6)} AS mse, {R(f'sqrt(avg({_E} * {_E}))', 6)} AS rmse,
  {R(f'avg(CASE WHEN l_discount <> 0 THEN 100 * abs({_E} / l_discount) END)')} AS mape,
  {R(f'avg(CASE WHEN abs({_E}) <= 1 THEN 0.5 * {_E} * {_E} ELSE abs({_E}) - 0.5 END)', 6)} AS huber,
  {R(f'sum({_E} * {_E}) / 2')} AS half_sse FROM lineitem GROUP BY l_tax""")
def _(spark, d):
    df = lineitem(spark, d).withColumn("pred", F.lit(0.05))
    out = M.regression_summary(df, "l_discount", "pred", ["l_tax"])
    return out.select("l_tax", rnd("mse", 6).alias("mse"), rnd("rmse", 6).alias("rmse"), rnd("mape").alias("mape"),
                      rnd("huber", 6).alias("huber"), rnd("half_sse").alias("half_sse"))


@query("a24_huber_loss", f"""SELECT {R('avg(CASE WHEN abs(l_quantity - 25) <= 1 THEN 0.5 * pow(l_quantity - 25, 2) ELSE abs(l_quantity - 25) - 0.5 END)')} AS huber,
  {R('avg(pow(l_quantity - 25, 2))')} AS mse FROM lineitem""")
def _(spark, d):
    e = F.col("l_quantity") - 25
    return lineitem(spark, d).agg(rnd(F.avg(M.huber_loss(e))).alias("huber"), rnd(F.avg(e * e)).alias("mse"))


_CM = """cm AS (SELECT sum((y = 1 AND p = 1)::BIGINT)::BIGINT AS tp, sum((y = 0 AND p = 1)::BIGINT)::BIGINT AS fp,
  sum((y = 1 AND p = 0)::BIGINT)::BIGINT AS fn, sum((y = 0 AND p = 0)::BIGINT)::BIGINT AS tn FROM x)"""


@query("a26_binary_report", f"""WITH {_BIN_SQL}, x AS (SELECT (label >= 5)::INTEGER AS y, neuron_label AS p FROM near JOIN lm USING (bmu)), {_CM}
SELECT tp, fp, fn, tn, {R('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {R('tp / (tp + fp)')} AS "precision",
  {R('tp / (tp + fn)')} AS recall, {R('2 * tp / (2 * tp + fp + fn)')} AS f1 FROM cm""")
def _(spark, d):
    rows = _binary(spark, d)
    from sensorweave.catalog.base import code25

    labelled = A.predict_label(rows, A.binary_label_map(rows, code25(spark, d).table(spark), "y"))
    out = M.binary_report(labelled, "y", "neuron_label")
    return out.select("tp", "fp", "fn", "tn", *rounded(["accuracy", "precision", "recall", "f1"]))


@query("a27_average_precision", f"""WITH s AS (SELECT l_quantity AS s, sum((l_discount > 0.05)::INTEGER) AS p, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER () AS all_p FROM s WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT {R('sum(p / all_p * tp / seen)', 6)} AS average_precision FROM c""")
def _(spark, d):
    df = lineitem(spark, d).withColumn("y", (F.col("l_discount") > 0.05).cast("int"))
    return M.average_precision(df, "y", "l_quantity").select(rnd("average_precision", 6).alias("average_precision"))


@query("s4_time_column_detection", """SELECT event_id, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS datetime, event_type FROM events""")
def _(spark, d):
    text = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when"), "event_type")
    return detect_time_column(text)
