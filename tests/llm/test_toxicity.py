"""The two language models of the toxicity operator against a plain reckoning."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sensorweave.llm import toxicity

P = toxicity.Params(discount=1.0)


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(160):
        w = [f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randrange(1, 60))]
        if i % 5 == 0:
            w[rng.randrange(len(w))] = "vile"
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    return rows


def by_hand(rows, p):
    """P(word | word before) of both classes, as a function of class, context and word, and P(word)."""
    pairs = {c: Counter() for c in (0, 1)}
    for _, text, c in rows:
        w = ["", *text.split()]
        pairs[c].update(zip(w, w[1:]))
    mass = {c: sum(pairs[c].values()) for c in pairs}
    scale = {c: min(mass.values()) / mass[c] for c in pairs}
    all_pairs = set(pairs[0]) | set(pairs[1])
    vocabulary = sorted({w for _, w in all_pairs})
    single = {c: Counter() for c in pairs}
    context = {c: Counter() for c in pairs}
    for c in pairs:
        for (v, w), n in pairs[c].items():
            single[c][w] += n * scale[c]
            context[c][v] += n * scale[c]
    before = Counter(w for _, w in all_pairs)
    pooled = {w: sum(pairs[c][q] for c in pairs for q in all_pairs if q[1] == w) for w in vocabulary}
    total = sum(pooled.values())
    shared = {w: (max(pooled[w] - 0.75, 0) + 0.75 * len(vocabulary) * before[w] / len(all_pairs)) / total for w in vocabulary}
    low = min(mass.values())

    def word(c, w):
        freed = sum(min(n, p.discount) for n in single[c].values()) / low
        return max(single[c][w] - p.discount, 0) / low + freed * shared[w]

    def given(c, v, w):
        n = context[c][v]
        if not n:
            return word(c, w)
        kept = {x: max(pairs[c][v, x] * scale[c] - p.discount, 0) for x in vocabulary}
        return kept[w] / n + (1 - sum(kept.values()) / n) * word(c, w)

    return word, given, vocabulary


def test_distributions_sum_to_one():
    word, given, vocabulary = by_hand(corpus(), P)
    for c in (0, 1):
        assert sum(word(c, w) for w in vocabulary) == pytest.approx(1)
        assert all(sum(given(c, v, w) for w in vocabulary) == pytest.approx(1) for v in ("", "w1", "vile", "never seen"))


@pytest.mark.parametrize("way", [toxicity._by_broadcast, toxicity._by_join])
def test_evidence_equals_the_reckoning_by_hand(spark, way):
    rows = corpus()
    model = toxicity.learn(spark.createDataFrame(rows, "key long, text string, toxic int").select("text", "toxic"), P)
    word, given, _ = by_hand(rows, P)
    asked = [(i, t) for i, t, _ in rows[:40]] + [(100, rows[0][1]), (None, rows[3][1]), (101, ""), (102, None), (103, "...")]
    out = spark.createDataFrame(asked, "key long, text string").withColumn("_fold", F.lit(0))
    got = way(out, model, P).collect()
    assert len(got) == len(asked)
    seen = {r.key: r for r in got}
    for key, text in asked:
        w = ["", *(text or "").replace(".", "").split()]
        n = len(w) - 1
        want = [0.0] * 4
        if n:
            alone = [math.log(word(1, x) / word(0, x)) for x in w[1:]]
            want = [sum(math.log(given(1, v, x) / given(0, v, x)) for v, x in zip(w, w[1:])) / n,
                    *[sum(a for a in alone if a > s) / n for s in P.strong], math.log1p(n)]
        assert [seen[key][f] for f in toxicity.FEATURES] == pytest.approx(want, abs=1e-9)


def test_scores_do_not_depend_on_the_way(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(0, rows[0][1], "again"), (None, None, None)], "doc_id long, text string, left string")
    labels = spark.createDataFrame([(i, c) for i, _, c in rows], "doc_id long, toxic int")
    one, two = [sorted((str(r.doc_id), r.held_out, round(r.score, 9)) for r in toxicity.score(d, labels, p=toxicity.Params(discount=1.0, model_rows=n)).collect())
                for n in (10 ** 6, 0)]
    assert one == two and len(one) == len(rows) + 2


def test_unknown_words_and_one_class(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "key long, text string, toxic int")
    assert toxicity.learn(frame.where("toxic = 0").select("text", "toxic"), P) is None
    model = toxicity.learn(frame.select("text", "toxic"), P)
    out = spark.createDataFrame([(1, "nobody wrote this")], "key long, text string").withColumn("_fold", F.lit(0))
    a, b = [way(out, model, P).first() for way in (toxicity._by_broadcast, toxicity._by_join)]
    first = model.words.where(F.col("key") == F.lit(int(toxicity.hashes("", toxicity._Hashes())[:1].view("int64")[0]))).first()
    assert a["mean"] == pytest.approx(model.rest + (first.left if first else 0.0) / 3) and a["mean"] == pytest.approx(b["mean"])
