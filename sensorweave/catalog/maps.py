"""Self-organizing maps and novelty."""

from dataclasses import replace

from pyspark.sql import functions as F

from sensorweave.catalog.base import (
    CB_SQL, COMPLETE_SQL, EMB_SQL, NEAR_SQL, R, SENS, SENSORS, code25, complete_sens, emb, query, rnd,
)
from sensorweave.operators import assign as A
from sensorweave.operators import bounds as B
from sensorweave.operators import codebook as C
from sensorweave.operators import novelty as V
from sensorweave.operators.diagnostics import centroid_spread, dispersion
from sensorweave.plans.novelty_run import NoveltyRun, working_hours_novelty
from sensorweave.sources.stage import stage
from sensorweave.plans.som_training import TrainingParams, fit, fit_bounded, fit_many, sweep_summary, sweep_table, update_one

NEAR2_SQL = NEAR_SQL + """, near2 AS (SELECT vec_id, max(bmu) FILTER (k = 1) AS b1, max(bmu) FILTER (k = 2) AS b2,
  max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2 FROM ranked GROUP BY vec_id)"""


def hits25(spark, d):
    return A.assign(emb(spark, d), code25(spark, d))


@query("n1_best_matching_unit", f"WITH {NEAR_SQL} SELECT vec_id, bmu FROM near")
def _(spark, d):
    return hits25(spark, d).select("vec_id", "bmu")


@query("j2_nearest_neuron_columns", """
WITH cb(bmu, a, b) AS (VALUES (0, 10.0, 0.02), (1, 25.0, 0.05), (2, 40.0, 0.08), (3, 25.0, 0.0)),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, bmu,
  (l_quantity - a) * (l_quantity - a) + (l_discount - b) * (l_discount - b) AS d2 FROM lineitem, cb),
n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, arg_min(bmu, (round(d2, 9), bmu)) AS bmu FROM p GROUP BY ALL)
SELECT bmu::INTEGER AS bmu, count(*) AS n FROM n GROUP BY 1""")
def _(spark, d):
    book = C.Codebook.from_rows([[10.0, 0.02], [25.0, 0.05], [40.0, 0.08], [25.0, 0.0]], 2, 2)
    from sensorweave.catalog.base import lineitem

    return A.assign_columns(lineitem(spark, d), book, ["l_quantity", "l_discount"]).groupBy("bmu").agg(
        F.count(F.lit(1)).alias("n"))


@query("n2_two_best_units", f"WITH {NEAR2_SQL} SELECT vec_id, b1, b2, {R('d1')} AS d1, {R('d2')} AS d2 FROM near2")
def _(spark, d):
    out = A.assign(emb(spark, d), code25(spark, d), k=2)
    return out.select("vec_id", F.col("bmus")[0].alias("b1"), F.col("bmus")[1].alias("b2"),
                      rnd(F.col("dists")[0]).alias("d1"), rnd(F.col("dists")[1]).alias("d2"))


@query("n3_unit_and_distance", f"""WITH {NEAR_SQL} SELECT vec_id, (bmu // 5)::INTEGER AS row, (bmu % 5)::INTEGER AS col,
  {R('d')} AS dmin FROM near""")
def _(spark, d):
    return hits25(spark, d).select("vec_id", "row", "col", rnd("dmin").alias("dmin"))


@query("n4_a30_quantization_error_inertia", f"WITH {NEAR_SQL} SELECT {R('avg(d)')} AS quantization_error, {R('sum(d * d)')} AS inertia FROM near")
def _(spark, d):
    return A.quantization_error(hits25(spark, d)).select(
        rnd("quantization_error").alias("quantization_error"), rnd("inertia").alias("inertia"))


@query("n5_topographic_error", f"""WITH {NEAR2_SQL} SELECT {R('avg((greatest(abs(b1 // 5 - b2 // 5), abs(b1 % 5 - b2 % 5)) > 1)::INTEGER)')}
  AS topographic_error FROM near2""")
def _(spark, d):
    out = A.topographic_error(A.assign(emb(spark, d), code25(spark, d), k=2), 5, 25)
    return out.select(rnd("topographic_error").alias("topographic_error"))


@query("n5_topographic_error_hexagonal", f"""WITH {NEAR2_SQL}, xy AS (SELECT
  b1 // 5 - CASE WHEN (4 - b1 % 5) % 2 = 0 THEN 0.5 ELSE 0 END AS x1, b1 % 5 AS y1,
  b2 // 5 - CASE WHEN (4 - b2 % 5) % 2 = 0 THEN 0.5 ELSE 0 END AS x2, b2 % 5 AS y2 FROM near2)
SELECT {R('avg((greatest(abs(x1 - x2), abs(y1 - y2)) > 1)::INTEGER)')} AS topographic_error FROM xy""")
def _(spark, d):
    out = A.topographic_error(A.assign(emb(spark, d), code25(spark, d), k=2), 5, 25, "hexagonal")
    return out.select(rnd("topographic_error").alias("topographic_error"))


@query("j8_n27_distance_table", f"WITH {NEAR_SQL} SELECT vec_id, bmu, {R('d')} AS dist FROM pairs")
def _(spark, d):
    out = A.distance_table(emb(spark, d), code25(spark, d))
    return out.select("vec_id", "bmu", rnd("dist").alias("dist"))


@query("j8_n27_distance_summary", f"""WITH {NEAR_SQL} SELECT bmu, count(*) AS n, {R('min(d)')} AS dmin, {R('avg(d)')} AS dmean, {R('max(d)')} AS dmax
FROM pairs GROUP BY bmu""")
def _(spark, d):
    out = B.distance_summary(emb(spark, d), code25(spark, d))
    return out.select("bmu", "n", *[rnd(c).alias(c) for c in ("dmin", "dmean", "dmax")])


@query("n27_codebook_vector_per_row", f"WITH {NEAR_SQL} SELECT vec_id, near.bmu, {R('w[1]')} AS w1, {R('w[64]')} AS w64 FROM near JOIN cb USING (bmu)")
def _(spark, d):
    book = code25(spark, d)
    out = A.quantize(emb(spark, d), book, book.table(spark))
    return out.select("vec_id", "bmu", rnd(F.col("w")[0]).alias("w1"), rnd(F.col("w")[63]).alias("w64"))


@query("j9_t5_k_nearest_nodes", f"WITH {NEAR_SQL} SELECT vec_id, k::INTEGER AS k, bmu, {R('d')} AS dist FROM ranked WHERE k <= 3")
def _(spark, d):
    out = A.assign(emb(spark, d), code25(spark, d), k=3)
    out = out.select("vec_id", F.posexplode(F.arrays_zip("bmus", "dists")).alias("i", "z"))
    return out.select("vec_id", (F.col("i") + 1).alias("k"), F.col("z.bmus").alias("bmu"), rnd("z.dists").alias("dist"))


for _metric, _expr in {
    "cosine": "1 - list_dot_product(features, w) / (sqrt(list_dot_product(features, features)) * sqrt(list_dot_product(w, w)) + 1e-8)",
    "manhattan": "list_sum(list_transform(list_zip(features, w), lambda p: abs(p[1] - p[2])))",
    "chebyshev": "list_max(list_transform(list_zip(features, w), lambda p: abs(p[1] - p[2])))",
}.items():
    @query(f"n26_{_metric}_distance", f"""WITH {CB_SQL}, pairs AS (SELECT vec_id, bmu, {_expr} AS d FROM emb, cb),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, bmu) AS k FROM pairs)
SELECT vec_id, bmu, {R('d')} AS dmin FROM ranked WHERE k = 1""")
    def _(spark, d, metric=_metric):
        out = A.assign(emb(spark, d), code25(spark, d), metric=metric)
        return out.select("vec_id", "bmu", rnd("dmin").alias("dmin"))


# --- maps over neurons ---------------------------------------------------------------------------

@query("a20_j7_hit_map", f"""WITH {NEAR_SQL} SELECT cb.bmu, r AS row, c AS col, count(vec_id) AS hits FROM cb LEFT JOIN near USING (bmu) GROUP BY ALL""")
def _(spark, d):
    return A.hit_map(hits25(spark, d), code25(spark, d).table(spark))


@query("a20_anomaly_hit_map", f"""WITH {NEAR_SQL} SELECT cb.bmu, r AS row, c AS col, count(vec_id) AS hits FROM cb
  LEFT JOIN (SELECT * FROM near WHERE d > 1.0) USING (bmu) GROUP BY ALL""")
def _(spark, d):
    return A.hit_map(hits25(spark, d).where("dmin > 1.0"), code25(spark, d).table(spark))


@query("a19_distance_maps", f"""WITH {NEAR_SQL} SELECT cb.bmu, r AS row, c AS col, {R('min(d)')} AS dmin, {R('max(d)')} AS dmax
  FROM cb LEFT JOIN near USING (bmu) GROUP BY ALL""")
def _(spark, d):
    out = A.distance_maps(hits25(spark, d), code25(spark, d).table(spark))
    return out.select("bmu", "row", "col", rnd("dmin").alias("dmin"), rnd("dmax").alias("dmax"))


@query("j1_map_lookup", f"""WITH {NEAR_SQL}, m AS (SELECT bmu, max(d) AS dmax FROM near GROUP BY 1)
SELECT vec_id, bmu, {R('dmax')} AS dmax FROM near JOIN m USING (bmu)""")
def _(spark, d):
    hits = hits25(spark, d)
    maps = A.distance_maps(hits, code25(spark, d).table(spark)).select("bmu", "dmax")
    return hits.join(F.broadcast(maps), "bmu").select("vec_id", "bmu", rnd("dmax").alias("dmax"))


@query("a28_unused_neurons", f"""WITH {NEAR_SQL}, h AS (SELECT cb.bmu, count(vec_id) AS n FROM cb LEFT JOIN near USING (bmu) GROUP BY 1)
SELECT {R('100 * avg((n = 0)::INTEGER)')} AS unused_pct FROM h""")
def _(spark, d):
    hits = A.hit_map(hits25(spark, d), code25(spark, d).table(spark))
    return A.unused_percent(hits).select(rnd("unused_pct").alias("unused_pct"))


@query("a32_label_counts", f"WITH {NEAR_SQL} SELECT bmu, label, count(*) AS n FROM near GROUP BY ALL")
def _(spark, d):
    return A.label_counts(hits25(spark, d), "label")


@query("a33_neuron_members", f"WITH {NEAR_SQL} SELECT bmu, (bmu // 5)::INTEGER AS row, (bmu % 5)::INTEGER AS col, vec_id FROM near")
def _(spark, d):
    return A.members(hits25(spark, d), "vec_id")


_BIN_SQL = NEAR_SQL + """, lm AS (SELECT cb.bmu, r, c, CASE WHEN count(vec_id) = 0 THEN 2
  WHEN avg((label >= 5)::INTEGER) > 0.5 THEN 1 ELSE 0 END::INTEGER AS neuron_label FROM cb LEFT JOIN near USING (bmu) GROUP BY ALL)"""


def _binary(spark, d):
    return hits25(spark, d).withColumn("y", (F.col("label") >= 5).cast("int"))


@query("n21_binary_label_map", f"WITH {_BIN_SQL} SELECT bmu, r AS row, c AS col, neuron_label FROM lm")
def _(spark, d):
    return A.binary_label_map(_binary(spark, d), code25(spark, d).table(spark), "y")


@query("n22_majority_label_map", f"""WITH {NEAR_SQL}, cnt AS (SELECT bmu, label, count(*) AS n, min(vec_id) AS f FROM near GROUP BY ALL),
b AS (SELECT bmu, label FROM (SELECT *, row_number() OVER (PARTITION BY bmu ORDER BY n DESC, f) AS k FROM cnt) WHERE k = 1)
SELECT cb.bmu, r AS row, c AS col, coalesce(label, 2)::INTEGER AS neuron_label FROM cb LEFT JOIN b USING (bmu)""")
def _(spark, d):
    return A.majority_label_map(hits25(spark, d), code25(spark, d).table(spark), "label", "vec_id")


@query("n23_classify_rows", f"WITH {_BIN_SQL} SELECT vec_id, (label >= 5)::INTEGER AS y, neuron_label FROM near JOIN lm USING (bmu)")
def _(spark, d):
    rows = _binary(spark, d)
    out = A.predict_label(rows, A.binary_label_map(rows, code25(spark, d).table(spark), "y"))
    return out.select("vec_id", "y", "neuron_label")


@query("n24_cluster_id", f"WITH {NEAR_SQL} SELECT vec_id, bmu AS cluster FROM near")
def _(spark, d):
    return hits25(spark, d).select("vec_id", F.col("bmu").alias("cluster"))


_SQUARE = "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.bmu <> b.bmu"
# Columns lie sqrt(3)/2 apart, every second one half a cell lower; neighbours are one cell away.
_HEX = "a.bmu <> b.bmu AND 0.75 * (b.c - a.c) ** 2 + (b.r - a.r + 0.5 * (b.c % 2 - a.c % 2)) ** 2 < 1.5"
for _name, _cond, _agg, _args in [
    ("n25_u_matrix_mean", _SQUARE, "avg", ("mean", "rectangular")),
    ("n25_u_matrix_sum", _SQUARE, "sum", ("sum", "rectangular")),
    ("n25_u_matrix_hexagonal", _HEX, "avg", ("mean", "hexagonal")),
]:
    @query(_name, f"""WITH {CB_SQL}, u AS (SELECT a.bmu, a.r, a.c, {_agg}(list_distance(a.w, b.w)) AS u FROM cb a JOIN cb b ON {_cond} GROUP BY ALL)
SELECT bmu, r AS row, c AS col, {R('u / (SELECT max(u) FROM u)')} AS u FROM u""")
    def _(spark, d, args=_args):
        return A.u_matrix(code25(spark, d), spark, *args).select("bmu", "row", "col", rnd("u").alias("u"))


@query("n28_grid_side", """SELECT count(*) AS n_rows, floor(5 * sqrt(count(*)))::BIGINT AS neurons,
  ceil(sqrt(floor(5 * sqrt(count(*)))))::BIGINT AS side FROM embeddings""")
def _(spark, d):
    return A.grid_side(emb(spark, d))


# --- one training step in closed form --------------------------------------------------------------

_W = "range(1, 65)"


def _kernel_sql(kind: str) -> str:
    dist = "abs(a.r - b.r) + abs(a.c - b.c)"
    return {"ceil": f"({dist} <= ceil(0.4 * 4))::DOUBLE", "half": f"pow(0.5, {dist})",
            "exp": f"exp(-pow({dist}, 2) / (2 * 0.8 * 0.8))", "mult": f"0.8 * ({dist})"}[kind]


for _kind, _sigma in [("ceil", 0.4), ("half", 1.0), ("exp", 0.8), ("mult", 0.8)]:
    @query(f"n10_kernel_{_kind}", f"""WITH {NEAR_SQL}, hits AS (SELECT bmu, count(*) AS n FROM near GROUP BY 1)
SELECT b.bmu, {R(f'sum(n * ({_kernel_sql(_kind)}))')} AS pull FROM hits JOIN cb a USING (bmu), cb b GROUP BY b.bmu""")
    def _(spark, d, kind=_kind, sigma=_sigma):
        # How strongly all rows together pull each neuron under this kernel.
        book = code25(spark, d)
        hits = A.hit_map(A.assign(emb(spark, d), book), book.table(spark))
        h = C.neighbourhood(book, kind, sigma)
        pairs = [(i, j, float(h[i, j])) for i in range(book.size) for j in range(book.size)]
        kernel = spark.createDataFrame(pairs, "hit int, bmu int, h double")
        pull = hits.select(F.col("bmu").alias("hit"), "hits").join(F.broadcast(kernel), "hit")
        return pull.groupBy("bmu").agg(rnd(F.sum(F.col("hits") * F.col("h"))).alias("pull"))


@query("n9_grid_distance_of_two_best", f"""WITH {NEAR2_SQL} SELECT abs(b1 // 5 - b2 // 5) + abs(b1 % 5 - b2 % 5) AS cityblock,
  {R('sqrt(pow(b1 // 5 - b2 // 5, 2) + pow(b1 % 5 - b2 % 5, 2))')} AS euclidean, count(*) AS n FROM near2 GROUP BY ALL""")
def _(spark, d):
    book = code25(spark, d)
    city, euclid = C.grid_distance(book), C.grid_distance(book, "euclidean")
    pairs = [(i, j, int(city[i, j]), float(euclid[i, j])) for i in range(book.size) for j in range(book.size)]
    grid = spark.createDataFrame(pairs, "b1 int, b2 int, cityblock int, euclidean double")
    two = A.assign(emb(spark, d), book, k=2).select(F.col("bmus")[0].alias("b1"), F.col("bmus")[1].alias("b2"))
    out = two.join(F.broadcast(grid), ["b1", "b2"]).groupBy("cityblock", rnd("euclidean").alias("euclidean"))
    return out.agg(F.count(F.lit(1)).alias("n"))


@query("n12_schedules_compared")
def _(spark, d):
    rows = stage(emb(spark, d).select("features"))
    kinds = ["exp", "linear", "mix", "inv", "constant", "step_ratio", "asymptotic"]
    start = code25(spark, d)
    params = {i: TrainingParams(epochs=3, kernel="exp", schedule=k, sigma=1.0, lr=0.5) for i, k in enumerate(kinds)}
    _books, history = fit_many(rows, {i: start for i in params}, params)
    out = [(kinds[i], t, e) for t, errors in enumerate(history) for i, e in errors.items()]
    return spark.createDataFrame(out, "schedule string, epoch int, mean_squared_distance double")


@query("n13_single_row_update", f"""WITH {NEAR_SQL}, x AS (SELECT features, near.bmu AS hit FROM emb JOIN near USING (vec_id) ORDER BY round(d, 9) DESC, vec_id LIMIT 1),
hit AS (SELECT x.features AS x, cb.r, cb.c FROM x JOIN cb ON cb.bmu = x.hit),
upd AS (SELECT b.bmu, list_transform(list_zip(b.w, a.x), lambda p: p[1] + 0.5 * exp(-pow(abs(a.r - b.r) + abs(a.c - b.c), 2) / (2 * 0.8 * 0.8)) * (p[2] - p[1])) AS w
  FROM cb b, hit a)
SELECT bmu, {R('w[1]', 6)} AS w1, {R('w[32]', 6)} AS w32, {R('list_sum(w)')} AS total FROM upd""")
def _(spark, d):
    # The row farthest from the map moves it.
    far = F.max(F.struct(F.round("dmin", 9), -F.col("vec_id"), F.col("features").alias("x")))
    x = hits25(spark, d).agg(far.alias("f")).select("f.x").first().x
    out = update_one(code25(spark, d), x, TrainingParams(kernel="exp"), 0.8, 0.5).table(spark)
    return _book_view(out)


def _book_view(t):
    return t.select("bmu", rnd(F.col("w")[0], 6).alias("w1"), rnd(F.col("w")[31], 6).alias("w32"),
                    rnd(F.aggregate("w", F.lit(0.0), lambda a, b: a + b)).alias("total"))


_P = "(pow(r - hr, 2) + pow(c - hc, 2))"
_TRAIN_KERNELS = {
    "exp": lambda s, step: f"exp(-pow(abs(r - hr) + abs(c - hc), 2) / (2 * {s} * {s}))",
    "ceil": lambda s, step: f"(abs(r - hr) + abs(c - hc) <= ceil({s} * {step}))::DOUBLE",
    "gaussian": lambda s, step: f"exp(-{_P} / (2 * {s} * {s}))",
    "mexican_hat": lambda s, step: f"exp(-{_P} / (2 * {s} * {s})) * (1 - {_P} / ({s} * {s}))",
    "bubble": lambda s, step: f"(abs(r - hr) < {s} AND abs(c - hc) < {s})::DOUBLE",
    "triangle": lambda s, step: f"greatest({s} - abs(r - hr), 0) * greatest({s} - abs(c - hc), 0)",
    "fixed_gaussian": lambda s, step: f"exp(-{_P} / ({s} * {s}))",
    "square": lambda s, step: (f"exp(-{_P} / 2 / {s}) * (r - hr >= -{step} AND r - hr < {step} "
                               f"AND c - hc >= -{step} AND c - hc < {step})::DOUBLE"),
    "density": lambda s, step: f"{s} * exp(-pow({_P}, 2) / 2) / sqrt(2 * pi())",
}


def _epoch_sql(cb: str, out: str, lr: float, h: str, rows: str = "emb", dim: int = 64) -> str:
    """One batch epoch from map ``cb``: sums per neuron, kernel-weighted means, a step of ``lr`` towards them."""
    return f""", {out}_pairs AS (SELECT vec_id, features, bmu, list_distance(features, w) AS d FROM {rows}, {cb}),
{out}_near AS (SELECT vec_id, features, arg_min(bmu, d) AS bmu FROM {out}_pairs GROUP BY vec_id, features),
{out}_dims AS (SELECT bmu, i, sum(features[i]) AS s, count(*) AS n FROM {out}_near, range(1, {dim + 1}) t(i) GROUP BY ALL),
{out}_pull AS (SELECT bmu, r, c, hit, {h} AS h FROM {cb}, (SELECT bmu AS hit, r AS hr, c AS hc FROM {cb})),
{out}_mix AS (SELECT p.bmu, i, CASE WHEN abs(sum(h * n)) > 1e-12 THEN sum(h * s) / sum(h * n) END AS m
  FROM {out}_pull p JOIN {out}_dims x ON x.bmu = p.hit GROUP BY ALL),
{out} AS (SELECT o.bmu, o.r, o.c, list(coalesce(o.w[i] + {lr} * (m - o.w[i]), o.w[i]) ORDER BY i) AS w
  FROM {cb} o JOIN {out}_mix USING (bmu) GROUP BY ALL)"""


#: Schedules as SQL text of the step ``t`` and the number of steps ``n``: what sigma and the rate are multiplied by.
_DECAY_SQL = {
    "constant": ("1.0", "1.0"), "linear": ("(1 - {t} / {n})", "(1 - {t} / {n})"), "exp": ("exp(-{t} * {ds})", "exp(-{t} * {dl})"),
    "mix": ("exp(-{t} / {n})", "(1 - {t} / {n})"), "inv": ("(1 / ({t} + 1))", "(1 / ({t} + 1))"),
    "asymptotic": ("(1 / (1 + {t} / ({n} / 2)))", "(1 / (1 + {t} / ({n} / 2)))"),
    "step_ratio": ("pow(1 + {ds} / ({n} / 2), -{t})", "pow(1 + {dl} / ({n} / 2), -{t})"),
}


def _epochs_sql(p: TrainingParams, book: str, rows: str = "emb", dim: int = 64) -> tuple[str, str]:
    """The epochs of a training as text, and the name of the map they end with."""
    sql = ""
    for t in range(p.epochs):
        sigma, lr = (f"({base} * {text.format(t=float(t), n=float(p.epochs), ds=p.sigma_decay, dl=p.lr_decay)})"
                     for base, text in zip((p.sigma, p.lr), _DECAY_SQL[p.schedule]))
        sql += _epoch_sql(book, f"e{t}", lr, _TRAIN_KERNELS[p.kernel](sigma, p.max_distance), rows, dim)
        book = f"e{t}"
    return sql, book


def _training_sql(p: TrainingParams) -> str:
    epochs, book = _epochs_sql(p, "cb")
    sql = CB_SQL + epochs
    return (f"WITH {sql} SELECT bmu, {R('w[1]', 6)} AS w1, {R('w[32]', 6)} AS w32, {R('list_sum(w)')} AS total FROM {book}")


for _name, _params in {
    "n14_one_batch_epoch": TrainingParams(epochs=1, kernel="exp", schedule="constant", sigma=0.8, lr=0.5),
    "n14_two_batch_epochs": TrainingParams(epochs=2, kernel="exp", schedule="linear", sigma=0.8, lr=0.5),
    "n14_disc_kernel_epochs": TrainingParams(epochs=2, kernel="ceil", schedule="linear", sigma=1.0, lr=0.5, max_distance=2.0),
    "n15_fixed_gaussian_trainer": TrainingParams(epochs=2, kernel="fixed_gaussian", sigma=1.5, lr=0.6, schedule="mix"),
    "n15_square_step_trainer": TrainingParams(epochs=2, kernel="square", max_distance=2, sigma=1.0, lr=0.5, schedule="exp"),
    "n15_density_trainer": TrainingParams(epochs=2, kernel="density", sigma=1.0, lr=0.5, schedule="exp"),
    "n11_gaussian_asymptotic_trainer": TrainingParams(epochs=2, kernel="gaussian", sigma=1.0, lr=0.5, schedule="asymptotic"),
    "n11_mexican_hat_trainer": TrainingParams(epochs=1, kernel="mexican_hat", sigma=0.7, lr=0.3, schedule="constant"),
    "n11_bubble_trainer": TrainingParams(epochs=2, kernel="bubble", sigma=2.0, lr=0.5, schedule="constant"),
    "n11_triangle_trainer": TrainingParams(epochs=2, kernel="triangle", sigma=2.0, lr=0.5, schedule="inv"),
    "n12_step_ratio_schedule": TrainingParams(epochs=3, kernel="exp", sigma=0.9, lr=0.6, schedule="step_ratio"),
    "n12_exponential_schedule": TrainingParams(epochs=3, kernel="exp", sigma=0.9, lr=0.6, schedule="exp"),
}.items():
    @query(_name, _training_sql(_params))
    def _(spark, d, params=_params):
        return _book_view(fit(emb(spark, d), code25(spark, d), params)[0].table(spark))


_BOUNDED = TrainingParams(epochs=4, kernel="exp", schedule="linear", sigma=0.8, lr=0.5)


@query("n14_bounded_epochs", _training_sql(_BOUNDED))
def _(spark, d):
    return _book_view(fit_bounded(emb(spark, d), code25(spark, d), _BOUNDED, tile=2)[0].table(spark))


_SHIFT = "CASE WHEN (4 - {c}) % 2 = 0 THEN 0.5 ELSE 0 END"
_HEX_P = f"(pow((r - {_SHIFT.format(c='c')}) - (hr - {_SHIFT.format(c='hc')}), 2) + pow(c - hc, 2))"

# Hexagonal maps: the same epoch with the neurons in their places on the plane.
for _name, _params, _h in [
    ("n14_hexagonal_gaussian", TrainingParams(epochs=1, kernel="gaussian", schedule="constant", sigma=0.8, lr=0.5), f"exp(-{_HEX_P} / (2 * 0.8 * 0.8))"),
    ("n14_hexagonal_mexican_hat", TrainingParams(epochs=1, kernel="mexican_hat", schedule="constant", sigma=0.7, lr=0.3),
     f"exp(-{_HEX_P} / (2 * 0.7 * 0.7)) * (1 - 2 * {_HEX_P} / (2 * 0.7 * 0.7))"),
]:
    @query(_name, f"WITH {CB_SQL} {_epoch_sql('cb', 'e0', _params.lr, _h)} SELECT bmu, {R('w[1]', 6)} AS w1, {R('w[32]', 6)} AS w32, {R('list_sum(w)')} AS total FROM e0")
    def _(spark, d, params=_params):
        return _book_view(fit(emb(spark, d), replace(code25(spark, d), topology="hexagonal"), params)[0].table(spark))


def _draws_sql(seed: int, neurons: int, dim: int, name: str = "u") -> str:
    """Two numbers in [0, 1) per neuron ``j`` and column ``i``, from the hash of their place."""
    def part(k: int) -> str:
        return f"(('0x' || substr(md5('{seed},{k},' || j || ',' || i), 1, 8))::BIGINT) / 4294967296.0"

    return f"{name} AS (SELECT j, i, {part(0)} AS u, {part(1)} AS v FROM range({neurons}) a(j), range({dim}) b(i))"


@query("n6_random_start", f"""WITH {EMB_SQL}, {_draws_sql(0, 25, 64)},
z AS (SELECT j, i, u, sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v) AS n, sqrt(sum(pow(2 * u - 1, 2)) OVER (PARTITION BY j)) AS len FROM u),
x AS (SELECT 'uniform' AS start, j, i, u AS w FROM z UNION ALL SELECT 'normal', j, i, n FROM z
  UNION ALL SELECT 'sq_normal', j, i, n * n - 1 FROM z UNION ALL SELECT 'unit', j, i, (2 * u - 1) / len FROM z),
b AS (SELECT start, j, list(w ORDER BY i) AS w FROM x GROUP BY ALL),
m AS (SELECT start, vec_id, min(list_distance(features, w)) AS d FROM emb, b GROUP BY ALL)
SELECT start, {R('avg(d)')} AS quantization_error FROM m GROUP BY start""")
def _(spark, d):
    parts = None
    for kind in ("uniform", "normal", "sq_normal", "unit"):
        qe = A.quantization_error(A.assign(emb(spark, d), C.random_codebook(5, 5, 64, kind, seed=0)))
        qe = qe.select(F.lit(kind).alias("start"), rnd("quantization_error").alias("quantization_error"))
        parts = qe if parts is None else parts.unionByName(qe)
    return parts


_RUN = NoveltyRun(rows=6, cols=6, start="05:00", end="17:30", training=TrainingParams(epochs=4, kernel="ceil", max_distance=3, lr=0.5))


def _run_sql(p: NoveltyRun) -> str:
    """Working hours of full weekdays, split by hash, scaled by the training rows; a trained map; three scores."""
    dim, size = len(SENSORS), p.rows * p.cols
    scaled = ", ".join(f"({s} - (SELECT avg({s}) FROM hours WHERE is_train)) / (SELECT coalesce(nullif(stddev_pop({s}), 0), 1) FROM hours WHERE is_train)" for s in SENSORS)
    epochs, book = _epochs_sql(p.training, "cb", "learnt", dim)
    return f"""WITH {COMPLETE_SQL}, open AS (SELECT * FROM full_sens WHERE ts::TIME BETWEEN '{p.start}:00' AND '{p.end}:00' AND isodow(ts) < 6),
days AS (SELECT ts::DATE AS d, count(*) AS n FROM open GROUP BY 1),
hours AS MATERIALIZED (SELECT *, 100 * ((('0x' || substr(md5('42,' || slot), 1, 8))::BIGINT) / 4294967296.0) < {p.train_percent} AS is_train
  FROM open WHERE ts::DATE IN (SELECT d FROM days WHERE n = (SELECT max(n) FROM days))),
vectors AS MATERIALIZED (SELECT slot AS vec_id, ts, is_train, [{scaled}] AS features FROM hours),
learnt AS (SELECT vec_id, features FROM vectors WHERE is_train), {_draws_sql(p.seed, size, dim)},
cb AS (SELECT j::INTEGER AS bmu, (j // {p.cols})::INTEGER AS r, (j % {p.cols})::INTEGER AS c, list(u ORDER BY i) AS w FROM u GROUP BY j){epochs},
book AS MATERIALIZED (SELECT bmu, w FROM {book}),
near AS MATERIALIZED (SELECT vec_id, ts, is_train, bmu, list_distance(features, w) AS d,
  row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(features, w), bmu) AS k FROM vectors, book),
own AS (SELECT bmu, max(d) AS dmax FROM near WHERE is_train AND k = 1 GROUP BY bmu),
whole AS (SELECT avg(d) AS m, max(d) AS worst FROM near WHERE is_train AND k = 1),
used AS (SELECT DISTINCT bmu FROM near WHERE NOT is_train AND k = 1),
knn AS (SELECT vec_id, avg(d) AS knn FROM (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, bmu) AS k
  FROM near JOIN used USING (bmu) WHERE NOT is_train) WHERE k <= {p.neighbours} GROUP BY vec_id),
scored AS (SELECT vec_id, ts, knn, d, m, worst, dmax FROM near LEFT JOIN own USING (bmu) JOIN knn USING (vec_id), whole WHERE NOT is_train AND k = 1)
SELECT vec_id AS slot, ts, {R('knn')} AS knn, {R('CASE WHEN d > worst THEN 0.0 WHEN d <= m THEN 1.0 WHEN d < worst THEN 1 - (d - m) / (worst - m) ELSE 0.0 END')} AS nd_worst,
  {R('CASE WHEN d > dmax THEN 0.0 WHEN d <= m THEN 1.0 WHEN d < dmax THEN 1 - (d - m) / (dmax - m) ELSE 0.0 END')} AS nd_by_bmu FROM scored"""


@query("n32_working_hours_novelty", _run_sql(_RUN))
def _(spark, d):
    out = working_hours_novelty(complete_sens(spark, d), SENS, SENSORS, ["slot"], _RUN)
    return out.select("slot", "ts", *[rnd(c).alias(c) for c in ("knn", "nd_worst", "nd_by_bmu")])


@query("n7_sampled_start", f"""WITH {EMB_SQL}, p AS (SELECT features, row_number() OVER (ORDER BY substr(md5('3,' || vec_id), 1, 8), vec_id) - 1 AS k FROM emb)
SELECT k::INTEGER AS bmu, (k // 5)::INTEGER AS row, (k % 5)::INTEGER AS col, features AS w FROM p WHERE k < 25""")
def _(spark, d):
    return C.sampled_codebook(emb(spark, d), "features", ["vec_id"], 5, 5, seed=3).table(spark)


@query("n8_principal_axis_start")
def _(spark, d):
    return C.pca_codebook(emb(spark, d), "features", 64, 5, 5).table(spark)


_SIDES, _SHARES, _DISPERSIONS = (3, 5), (0.4, 0.9), (0.5, 2.0)


def _literal_map(config, dim):
    """A first map that SQL can write down too."""
    weights = [[((b * 7 + i * 13) % 17) / 17.0 - 0.5 for i in range(1, dim + 1)] for b in range(config.side ** 2)]
    return C.Codebook.from_rows(weights, config.side, config.side)


def _sweep_sql():
    """One epoch of every configuration from literal maps, then the neurons that no row of its sample hits."""
    parts, rows = [EMB_SQL, "hs AS (SELECT *, (('0x' || substr(md5('42,' || vec_id), 1, 8))::BIGINT) / 4294967296.0 AS share FROM emb)"], []
    for i, (s, d, g) in enumerate((s, d, g) for s in _SHARES for d in _DISPERSIONS for g in _SIDES):
        parts.append(f"x{i} AS (SELECT vec_id, list_transform(features, lambda v: v * {d}) AS features FROM hs WHERE share < {s})")
        parts.append(f"m{i} AS (SELECT b::INTEGER AS bmu, (b // {g})::INTEGER AS r, (b % {g})::INTEGER AS c, "
                     f"list_transform(range(1, 65), lambda i: ((b * 7 + i * 13) % 17) / 17.0 - 0.5) AS w FROM range({g * g}) t(b))")
        epoch = _epoch_sql(f"m{i}", f"o{i}", 0.5, _TRAIN_KERNELS["exp"](1.0, 0)).replace("FROM emb,", f"FROM x{i},")
        parts.append(epoch.lstrip(", "))
        parts.append(f"u{i} AS (SELECT count(DISTINCT bmu) AS n FROM (SELECT vec_id, arg_min(bmu, list_distance(features, w)) AS bmu FROM x{i}, o{i} GROUP BY vec_id))")
        parts.append(f"ce{i} AS (SELECT list(v ORDER BY j) AS c FROM (SELECT j, avg(features[j]) AS v FROM x{i}, range(1, 65) t(j) GROUP BY j))")
        rows.append(f"SELECT (SELECT count(*) FROM x{i}) AS size, {d}::DOUBLE AS disp, (SELECT {R('stddev_pop(v)', 6)} FROM (SELECT unnest(features) AS v FROM x{i})) AS std, "
                    f"(SELECT {R('stddev_pop(list_distance(features, c))', 6)} FROM x{i}, ce{i}) AS centroid_std, {g}::INTEGER AS som_size, "
                    f"{R(f'100.0 * ({g * g} - n) / {g * g}')} AS unused_pct FROM u{i}")
    return ", ".join(parts), " UNION ALL ".join(rows)


def _swept(spark, d):
    return sweep_table(emb(spark, d), "features", ["vec_id"], _SHARES, _DISPERSIONS, _SIDES,
                       TrainingParams(epochs=1, kernel="exp", sigma=1.0, lr=0.5, schedule="constant"), _literal_map)


@query("n29_grid_size_sweep", "WITH {} {}".format(*_sweep_sql()))
def _(spark, d):
    return _swept(spark, d).select("size", "disp", rnd("std", 6).alias("std"), rnd("centroid_std", 6).alias("centroid_std"), "som_size",
                                   rnd("unused_pct").alias("unused_pct"))


@query("a29_unused_by_sample_size", "WITH {}, t AS ({}) SELECT size, {} AS mean_unused, {} AS max_unused, count(*) AS n FROM t GROUP BY size".format(
    *_sweep_sql(), R("avg(unused_pct)"), R("max(unused_pct)")))
def _(spark, d):
    out = sweep_summary(_swept(spark, d))
    return out.select("size", rnd("mean_unused").alias("mean_unused"), rnd("max_unused").alias("max_unused"), "n")


_PCA_K = 2


@query("n30_principal_components")
def _(spark, d):
    mean, cov, _n = C.covariance(emb(spark, d), "features", 64)
    axes, share = C.principal_axes(cov, _PCA_K)

    def along(k):
        terms = [(F.col("features")[i] - float(mean[i])) * float(axes[i, k]) for i in range(64)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total

    return emb(spark, d).select("vec_id", *[along(k).alias(f"pc{k + 1}") for k in range(_PCA_K)],
                                *[F.lit(float(s)).alias(f"share{k + 1}") for k, s in enumerate(share)])


@query("n30_two_column_components", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  l_quantity AS u, l_extendedprice / 1000.0 AS v FROM lineitem),
m AS (SELECT avg(u) AS mu, avg(v) AS mv, var_samp(u) AS a, var_samp(v) AS c, covar_samp(u, v) AS b FROM x),
e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS top FROM m),
f AS (SELECT *, (top - c) / sqrt(pow(top - c, 2) + b * b) AS ax, b / sqrt(pow(top - c, 2) + b * b) AS ay FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, """ + R("(u - mu) * ax + (v - mv) * ay") + " AS pc1, "
       + R("top / (a + c)", 6) + " AS share1 FROM x, f")
def _(spark, d):
    from sensorweave.catalog.base import LINE_KEY, lineitem

    pair = [F.col("l_quantity"), F.col("l_extendedprice") / 1000.0]
    df = lineitem(spark, d).select(*LINE_KEY, F.array(*pair).alias("features"))
    mean, cov, _n = C.covariance(df, "features", 2)
    axes, share = C.principal_axes(cov, 1)
    pc1 = sum((F.col("features")[i] - float(mean[i])) * float(axes[i, 0]) for i in range(2))
    return df.select(*LINE_KEY, rnd(pc1).alias("pc1"), rnd(F.lit(float(share[0])), 6).alias("share1"))


@query("n8_two_column_start", f"""WITH m AS (SELECT var_samp(l_quantity) AS a, var_samp(l_extendedprice / 1000.0) AS c, covar_samp(l_quantity, l_extendedprice / 1000.0) AS b FROM lineitem),
t AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS top FROM m),
f AS (SELECT (top - c) / sqrt(pow(top - c, 2) + b * b) AS p, b / sqrt(pow(top - c, 2) + b * b) AS q FROM t),
g AS (SELECT CASE WHEN abs(p) >= abs(q) THEN sign(p) ELSE sign(q) END AS s, CASE WHEN abs(q) >= abs(p) THEN -sign(q) ELSE sign(p) END AS o, p, q FROM f)
SELECT (5 * i + j)::INTEGER AS bmu, i::INTEGER AS row, j::INTEGER AS col, {R('(i / 1.5 - 1) * s * p - (j / 2.0 - 1) * o * q')} AS w0,
  {R('(i / 1.5 - 1) * s * q + (j / 2.0 - 1) * o * p')} AS w1 FROM g, range(4) x(i), range(5) y(j)""")
def _(spark, d):
    from sensorweave.catalog.base import lineitem

    df = lineitem(spark, d).select(F.array("l_quantity", F.col("l_extendedprice") / 1000.0).alias("features"))
    out = C.pca_codebook(df, "features", 2, 4, 5).table(spark)
    return out.select("bmu", "row", "col", *[rnd(F.col("w")[i]).alias(f"w{i}") for i in (0, 1)])


@query("n30_projection_variance", """WITH e AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
SELECT (round(sum(v) + 1e-7, 4) + 0.0) AS total_variance FROM (SELECT i, var_samp(x) AS v FROM e GROUP BY i)""")
def _(spark, d):
    _mean, cov, _n = C.covariance(emb(spark, d), "features", 64)
    axes, share = C.principal_axes(cov, 64)
    # The axes together carry the whole variance of the data.
    total = float(sum((axes[:, k] @ cov @ axes[:, k]) for k in range(64)))
    return emb(spark, d).agg(rnd(F.lit(total)).alias("total_variance"))


# --- novelty -----------------------------------------------------------------------------------------

SPLIT_SQL = NEAR_SQL + """, train AS (SELECT * FROM near WHERE vec_id % 5 <> 4), test AS (SELECT * FROM near WHERE vec_id % 5 = 4)"""


def train(spark, d):
    return emb(spark, d).where("vec_id % 5 <> 4")


def test(spark, d):
    return emb(spark, d).where("vec_id % 5 = 4")


def _knn_sql(counted: str) -> str:
    return SPLIT_SQL + f""", okay AS (SELECT bmu FROM {counted} GROUP BY bmu HAVING count(*) >= 2),
kr AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, bmu) AS kk FROM pairs JOIN okay USING (bmu) WHERE vec_id % 5 = 4),
knn AS (SELECT vec_id, avg(d) AS knn FROM kr WHERE kk <= 3 GROUP BY vec_id)"""


@query("n17_knn_novelty", f"WITH {_knn_sql('test')} SELECT vec_id, {R('knn')} AS knn FROM knn")
def _(spark, d):
    return V.knn_novelty(test(spark, d), code25(spark, d), min_hits=2).select("vec_id", rnd("knn").alias("knn"))


@query("n17_knn_novelty_train_counts", f"WITH {_knn_sql('train')} SELECT vec_id, {R('knn')} AS knn FROM knn")
def _(spark, d):
    out = V.knn_novelty(test(spark, d), code25(spark, d), min_hits=2, count_on=train(spark, d))
    return out.select("vec_id", rnd("knn").alias("knn"))


@query("n18_dmax_worst", f"WITH {SPLIT_SQL} SELECT cb.bmu, {R('(SELECT avg(d) FROM train)')} AS mean_dist, {R('(SELECT max(d) FROM train)')} AS dmax FROM cb")
def _(spark, d):
    out = V.training_stats(train(spark, d), code25(spark, d), "worst")
    return out.select("bmu", rnd("mean_dist").alias("mean_dist"), rnd("dmax").alias("dmax"))


@query("n18_dmax_by_neuron", f"""WITH {SPLIT_SQL} SELECT cb.bmu, {R('(SELECT avg(d) FROM train)')} AS mean_dist, {R('max(d)')} AS dmax
  FROM cb LEFT JOIN train USING (bmu) GROUP BY cb.bmu""")
def _(spark, d):
    out = V.training_stats(train(spark, d), code25(spark, d), "by_bmu")
    return out.select("bmu", rnd("mean_dist").alias("mean_dist"), rnd("dmax").alias("dmax"))


def _qe_sql(method: str, f: float) -> str:
    dmax = "(SELECT max(d) FROM train)" if method == "worst" else "(SELECT max(d) FROM train t WHERE t.bmu = test.bmu)"
    return f""", qe_{method} AS (SELECT vec_id, d, CASE WHEN d > dm THEN 0.0 WHEN d <= m THEN 1.0 WHEN d < dm THEN 1 - (d - m) / (dm - m) ELSE 0.0 END AS nd
  FROM (SELECT vec_id, d, (SELECT avg(d) FROM train) AS m, {f} * {dmax} AS dm FROM test))"""


def qe(spark, d, method, f=1.0, out="nd"):
    book = code25(spark, d)
    return V.qe_novelty(test(spark, d), V.training_stats(train(spark, d), book, method), book, fiability=f, out=out)


@query("n19_qe_novelty_worst", f"WITH {SPLIT_SQL} {_qe_sql('worst', 0.9)} SELECT vec_id, {R('nd')} AS nd FROM qe_worst")
def _(spark, d):
    return qe(spark, d, "worst", 0.9).select("vec_id", rnd("nd").alias("nd"))


@query("n19_qe_novelty_by_neuron", f"WITH {SPLIT_SQL} {_qe_sql('by_bmu', 1.0)} SELECT vec_id, {R('nd')} AS nd FROM qe_by_bmu")
def _(spark, d):
    return qe(spark, d, "by_bmu").select("vec_id", rnd("nd").alias("nd"))


@query("n20_compare_scores", f"""WITH {SPLIT_SQL} {_qe_sql('worst', 1.0)} {_qe_sql('by_bmu', 1.0)}
SELECT sum((a.nd < 0.5 AND b.nd < 0.5)::BIGINT)::BIGINT AS "both", sum((a.nd < 0.5 AND NOT b.nd < 0.5)::BIGINT)::BIGINT AS only_x,
  sum((NOT a.nd < 0.5 AND b.nd < 0.5)::BIGINT)::BIGINT AS only_y, sum((NOT a.nd < 0.5 AND NOT b.nd < 0.5)::BIGINT)::BIGINT AS neither,
  {R('corr(a.nd, b.nd)')} AS corr FROM qe_worst a JOIN qe_by_bmu b USING (vec_id)""")
def _(spark, d):
    out = V.compare_scores(qe(spark, d, "worst", out="x"), qe(spark, d, "by_bmu", out="y"), "vec_id", "x", "y", 0.5, 0.5)
    return out.select("both", "only_x", "only_y", "neither", rnd("corr").alias("corr"))


@query("p13_novel_rows", f"WITH {SPLIT_SQL} {_qe_sql('by_bmu', 1.0)} SELECT vec_id, {R('nd')} AS nd FROM qe_by_bmu WHERE nd < 0.25")
def _(spark, d):
    return qe(spark, d, "by_bmu").where("nd < 0.25").select("vec_id", rnd("nd").alias("nd"))


_DIST = "sqrt(" + " + ".join(f"(h.{s} - q.{s}) * (h.{s} - q.{s})" for s in SENSORS) + ")"
MATCH_SQL = COMPLETE_SQL + f""", q AS (SELECT slot AS q_slot, {", ".join(f"{s} + 0.01 AS {s}" for s in SENSORS)} FROM full_sens WHERE view > 25 OR click > 25),
mp AS (SELECT q_slot, h.ts, {_DIST} AS dist FROM q, full_sens h),
match AS (SELECT q_slot, arg_min(ts, (round(dist, 9), ts)) AS match_ts, min(dist) AS dist FROM mp GROUP BY q_slot)"""


def _matches(spark, d):
    hist = complete_sens(spark, d)
    novel = hist.where("view > 25 OR click > 25").select(
        F.col("slot").alias("q_slot"), *[(F.col(s) + 0.01).alias(s) for s in SENSORS])
    return V.nearest_record(hist, novel, SENSORS, "ts", "q_slot", digits=9)


@query("j4_t2_nearest_record", f"WITH {MATCH_SQL} SELECT q_slot, match_ts, {R('dist')} AS dist FROM match")
def _(spark, d):
    return _matches(spark, d).select("q_slot", "match_ts", rnd("dist").alias("dist"))


@query("j5_n31_matched_day_rows", f"""WITH {MATCH_SQL} SELECT q_slot, match_ts, slot, ts FROM full_sens JOIN match ON ts::DATE = match_ts::DATE""")
def _(spark, d):
    found = V.day_context(complete_sens(spark, d), "ts", _matches(spark, d), "q_slot")
    return found.select("q_slot", "match_ts", "slot", "ts")


@query("j6_identical_rows", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE (l_quantity, l_discount) IN (SELECT (l_quantity, l_discount) FROM lineitem WHERE l_tax > 0.07 AND l_quantity < 3)")
def _(spark, d):
    from sensorweave.catalog.base import lineitem

    df = lineitem(spark, d)
    out = V.shared_rows(df, df.where("l_tax > 0.07 AND l_quantity < 3"), ["l_quantity", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("j6_rows_not_shared", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE (l_quantity, l_discount, l_tax) NOT IN (SELECT (l_quantity, l_discount, l_tax) FROM lineitem WHERE l_extendedprice < 20000)")
def _(spark, d):
    from sensorweave.catalog.base import lineitem

    df = lineitem(spark, d)
    out = V.shared_rows(df, df.where("l_extendedprice < 20000"), ["l_quantity", "l_discount", "l_tax"], keep=False)
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("a31_detection_share", f"""WITH {SPLIT_SQL} {_qe_sql('by_bmu', 1.0)}, det AS (SELECT vec_id FROM qe_by_bmu WHERE nd < 0.25)
SELECT {R('avg((label >= 5)::INTEGER)')} AS share FROM det JOIN emb USING (vec_id)""")
def _(spark, d):
    out = V.detection_share(qe(spark, d, "by_bmu").where("nd < 0.25"), emb(spark, d).where("label >= 5"), ["vec_id"])
    return out.select(rnd("share").alias("share"))


# --- dispersion -----------------------------------------------------------------------------------------

_CELLS = "cells AS (SELECT label, unnest(features) AS x FROM emb)"


def _dispersion_sql(by: str) -> str:
    return (f"{R('var_pop(x)')} AS variance, {R('stddev_pop(x)')} AS std, {R('max(x) - min(x)')} AS range, "
            f"{R('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)')} AS iqr FROM cells {by}")


@query("a13_matrix_dispersion", f"WITH {EMB_SQL}, {_CELLS} SELECT {_dispersion_sql('')}")
def _(spark, d):
    return dispersion(emb(spark, d), "features").select(*[rnd(c).alias(c) for c in ("variance", "std", "range", "iqr")])


@query("a14_dispersion_by_group", f"WITH {EMB_SQL}, {_CELLS} SELECT label, {_dispersion_sql('GROUP BY label')}")
def _(spark, d):
    return dispersion(emb(spark, d), "features", ["label"]).select(
        "label", *[rnd(c).alias(c) for c in ("variance", "std", "range", "iqr")])


@query("a15_centroid_spread", f"""WITH {EMB_SQL}, m AS (SELECT list(v ORDER BY i) AS c FROM (SELECT i, avg(features[i]) AS v FROM emb, range(1, 65) t(i) GROUP BY i))
SELECT {R('avg(list_distance(features, c))')} AS mean_distance, {R('stddev_pop(list_distance(features, c))')} AS centroid_std FROM emb, m""")
def _(spark, d):
    out = centroid_spread(emb(spark, d), "features", 64)
    return out.select(rnd("mean_distance").alias("mean_distance"), rnd("centroid_std").alias("centroid_std"))


@query("a16_class_distribution", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def _(spark, d):
    return emb(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("a29_sweep_summary", f"""WITH {NEAR_SQL}, cfg AS (SELECT unnest([5, 10, 15, 20, 25]) AS som_size),
h AS (SELECT som_size, label, bmu, min(vec_id) AS f FROM cfg JOIN pairs ON bmu < som_size GROUP BY ALL),
best AS (SELECT som_size, label, vec_id, arg_min(bmu, d) AS bmu FROM cfg JOIN pairs ON bmu < som_size GROUP BY ALL)
SELECT som_size::INTEGER AS som_size, label, {R('100.0 * (som_size - count(DISTINCT bmu)) / som_size')} AS unused_pct FROM best GROUP BY som_size, label ORDER BY som_size, label""")
def _(spark, d):
    book = code25(spark, d)
    out = None
    for n in (5, 10, 15, 20, 25):
        small = C.Codebook(book.weights[:n], 1, n)
        used = A.assign(emb(spark, d), small).select("label", "bmu").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("u"))
        row = used.select(F.lit(n).alias("som_size"), "label", rnd(100.0 * (n - F.col("u")) / n).alias("unused_pct"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy("som_size", "label")
