import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorweave.llm import prefix_trie, pu_quality, whitening

VECTORS = "vec_id long, embedding array<float>, _row string, x string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "clash", None) for i, v in rows], VECTORS)


def whitened_by_hand(rows, k):
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(float)) + 1_000_000 for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s) / n
    value, vector = np.linalg.eigh(z.T @ z / n)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return z @ (vector / np.sqrt(value)), value, value / np.trace(z.T @ z / n), ((n * x - s) ** 2).sum(axis=1)


@pytest.mark.parametrize("dim,k,guard", [(40, 8, 6), (6, 32, 8)])
def test_whitening_equals_a_dense_solve(spark, dim, k, guard):
    rng = np.random.default_rng(dim)
    data = rng.normal(size=(400, dim)) * np.linspace(3, 0.5, dim) + rng.normal(size=dim) * 10
    data[50:90] = data[0]  # repeated rows count
    rows = list(enumerate(data.astype(np.float32).tolist()))
    got = whitening.whiten(vectors(spark, rows).repartition(5), p=whitening.Params(components=k, guard=guard)).toPandas()
    k = min(k, dim)
    want, value, explained, deviation = whitened_by_hand(rows, k)
    assert len(got) == 400 * k and set(got.n) == {400} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    got["id"] = [r["vec_id"] for r in got._row]
    table = got.pivot(index="id", columns="component", values="whitened").to_numpy()
    sign = np.sign((table * want).sum(axis=0))
    assert np.abs(table * sign - want).max() < 1e-8
    first = got[got.id == 7].sort_values("component")
    assert np.allclose(first.explained, explained, rtol=1e-10) and set(first.deviation) == {int(deviation[7])}


def test_whitening_passes_fall_with_the_filter(spark):
    """A flat spectrum: the recurrence needs far fewer passes than plain subspace iteration would."""
    rng = np.random.default_rng(1)
    data = rng.normal(size=(600, 48)) * np.sqrt(np.linspace(1.3, 0.9, 48))
    rows = whitening.prepare(vectors(spark, list(enumerate(data.tolist()))))
    found = whitening.axes(rows, whitening.Params(components=6, guard=6))
    assert found.passes < 80 and (found.residuals <= 64 * whitening.EPS * found.values[0]).all()
    with pytest.raises(whitening.NotCertified):
        whitening.axes(rows, whitening.Params(components=6, guard=6, passes=5))


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (None, [3.0, 1.0]), (1, [1.0, 2.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [1.0, inf]),
            (8, []), (9, [1.0, 2.0, 3.0]), (10, [1e30, 0.0]), (11, [-2.0, 5.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert sorted(str(r._row.vec_id) for r in got) == sorted(str(i) for i in (1, None, 1, 11) for _ in range(2))
    assert {r._row.component for r in got} == {None} and {r.n for r in got} == {4}
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0  # equal vectors: no axis
    assert whitening.whiten(vectors(spark, [])).count() == 0 == whitening.whiten(vectors(spark, [(1, None)])).count()
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_deviation_beyond_a_long_is_null():
    a = whitening.Axes(10 ** 9, np.array([0, 0]), [0, 0], np.eye(2), np.ones(2), np.zeros(2), 2.0, 1)
    assert a.deviation(np.array([[10 ** 3, 0], [10, 2]])) == [None, None] and a.deviation(np.array([[2, 1]])) == [5 * 10 ** 18]


TURNS = "conv_id long, turn long, role string, text string, conv string, node string"


def name_of(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def trie_by_hand(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, name_of(r or "", x or ""), r or "", x or ""))
    own = {c: [y[3:] for y in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    nodes, kids = {}, {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        todo = [k]
        while todo:
            k = todo.pop()
            yield k
            todo += kids.get(k, [])

    out = []
    for k, m in nodes.items():
        sub = list(below(k))
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), sum(q not in kids for q in sub),
                    sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in sub if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)
    got = prefix_trie.conversation_trie(df, prefix_trie.Params(**options)).select(*COLUMNS)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("options", [{"leaf": 2, "hot": 1}, {"leaf": 4}, {}])
def test_trie_against_all_prefixes(spark, options):
    rng = random.Random(2)
    rows = []
    for c in [*range(30), 70_001, 70_003, 200_000]:
        for t in range(rng.choice([1, 2, 3, 9, 12, 33])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", None]), rng.choice(["a", "bé", None, "hello"])))
    rows += [(None, 1, "user", "x"), (3, 1, "user", "twice"), (3, 1, "user", "twice")]
    assert trie_of(spark, rows, **options) == trie_by_hand(rows)


def test_trie_of_one_long_and_many_equal_conversations(spark):
    rows = [(7, i, "user", f"turn {i % 3}") for i in range(700)]  # far more than half of all rows
    rows += [(1000 + i, t, "user", "same" * t) for i in range(40) for t in range(2)] + [(5000, 0, None, "x" * 200_000)]
    assert trie_of(spark, rows, leaf=16) == trie_by_hand(rows)


def test_trie_without_conversations(spark):
    assert trie_of(spark, []) == [] == trie_of(spark, [(None, 1, "user", "x")])
    alone = [(4, None, None, None)]
    assert trie_of(spark, alone) == trie_by_hand(alone)


def test_id_lists_are_hashed_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    rows = [(bytes([i % 3]) * 16, c) for i, c in enumerate([-9, -1, 0, 3, 4, 5, 17, 400, 2 ** 40])]
    got = prefix_trie._ends_sha256(spark.createDataFrame(rows, "node binary, conv long")).collect()
    want = {k: ",".join(str(c) for n, c in sorted(rows, key=lambda r: r[1]) if n == k) for k, _ in rows}
    assert {bytes(r.node): r.sha256 for r in got} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


DOCS = "doc_id long, text string, x string, score string, h1 string"


def corpus(n, seed=3):
    rng = random.Random(seed)
    texts, good = [], []
    for i in range(n):
        w = [f"{rng.choice('abcdefgh')}word{rng.randrange(900)}" for _ in range(rng.randrange(30, 90))]
        good.append(int(i % 5 > 0))
        if not good[-1]:
            w = [x + "###" if rng.random() < 0.5 else x.upper() + "!!" for x in w] if i % 2 else [w[0]] * len(w)
        texts.append(" ".join(w))
    return texts, good


def test_positive_unlabelled_learning_without_negatives(spark):
    texts, good = corpus(1500)
    df = spark.createDataFrame([(i, t, "clash", None, None) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1) for i, y in enumerate(good) if y and i % 3 == 0], "doc_id long, quality int")
    got = pu_quality.score(df, labels).collect()  # no row says what a bad text is
    assert len(got) == 1500 and abs(got[0].prior - 0.8) < 0.08
    held = [(r.score >= 0.3, good[r.doc_id]) for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(p == bool(y) for p, y in held) >= 0.97 * len(held)


def test_held_out_labels_change_nothing(spark):
    texts, good = corpus(300)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    rows = list(enumerate(good))
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in rows]
    a, b = (sorted((r.doc_id, r.score) for r in pu_quality.score(df, spark.createDataFrame(x, "doc_id long, quality int")).collect())
            for x in (rows, turned))
    assert all(abs(u[1] - v[1]) < 1e-9 for u, v in zip(a, b))


def test_risk_and_slope_by_hand(spark):
    """The pass gives the terms of the risk; its gradient agrees with differences of the risk."""
    texts, good = corpus(120)
    x = np.array([pu_quality.features(t) for t in texts])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    df = spark.createDataFrame([(r.tolist(), y, i % 2) for i, (r, y) in enumerate(zip(x, good))], "x array<double>, positive int, half int")
    e, y = pu_quality.expanded(x, mean, scale), np.array(good) == 1
    w = np.random.default_rng(1).normal(size=e.shape[1]) / 10

    def risk(w):
        z = e @ w
        return (0.7 * np.logaddexp(0, -z[y]).mean() + np.logaddexp(0, z).mean() - 0.7 * np.logaddexp(0, z[y]).mean())

    m = pu_quality.moments(df, w, mean, scale)
    assert abs(0.7 * m.pull_p + m.loss_u - 0.7 * m.loss_p - risk(w)) < 1e-9
    slope = m.grad_u - 0.7 * m.mean_p
    for i in range(0, len(w), 7):
        step = np.eye(len(w))[i] * 1e-5
        assert abs((risk(w + step) - risk(w - step)) / 2e-5 - slope[i]) < 1e-6
    assert (pu_quality.fit(df, 0.99, mean, scale) != 0).any()  # a prior too high drives the negative part below zero


def test_quality_of_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, " \n"), (3, "x"), (None, "some text"), (5, "word " * 200_000), (6, "x" * 300_000), (6, "x" * 300_000)]
    df = spark.createDataFrame([(i, t, "c", None, None) for i, t in odd], DOCS)
    for labels in ([], [(5, 1), (None, 1), (1, None), (6, 0)]):
        got = pu_quality.score(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert pu_quality.score(df.limit(0), df.select("doc_id", F.lit(1).alias("quality"))).count() == 0
