"""The Bloom filter of the row comparison: it never loses a tuple and keeps most others out of the shuffle."""

import pytest
from pyspark.sql import functions as F

from sensorweave.operators import novelty as V
from sensorweave.operators import sketch as S


def pairs(spark, n, step, offset=0):
    return spark.range(n).select((F.col("id") * step + offset).alias("a"), F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 5) / 2).alias("b"))


def test_filter_holds_all_it_was_given_and_few_others(spark):
    values = [F.col("a"), F.col("b")]
    sketch = S.bit_sketch(pairs(spark, 20_000, 2), values, 20).cache()
    assert sketch.count() <= 2 ** 5
    assert S.with_maybe(pairs(spark, 20_000, 2), sketch, values, 20).where("NOT _maybe").count() == 0
    others = S.with_maybe(pairs(spark, 20_000, 2, 1), sketch, values, 20)
    assert others.columns == ["a", "b", "_maybe"] and others.count() == 20_000
    assert others.where("_maybe").count() < 0.01 * 20_000  # two bits of a million, 40,000 set: some 30 by chance


@pytest.mark.parametrize("bits", [15, 24])
def test_comparison_equals_sets_whatever_the_filter(spark, bits):
    a = spark.createDataFrame([(i % 40, float(i % 3) if i % 4 else None, i) for i in range(400)] + [(1, -0.0, 400), (1, float("nan"), 401)] + [(7, 7.0, i) for i in range(500, 700)],
                              "a int, b double, id int")
    b = spark.createDataFrame([(i, float(i % 3) if i % 5 else None) for i in range(0, 40, 2)] + [(1, 0.0), (1, float("nan")), (7, 7.0), (7, 7.0)], "a long, b double")

    def key(r):
        return r.a, "nan" if r.b is not None and r.b != r.b else (r.b + 0.0 if r.b is not None else None)

    there = {key(r) for r in b.collect()}
    for keep in (True, False):
        want = sorted(r.id for r in a.collect() if (key(r) in there) == keep)
        got = V.shared_rows(a, b, ["a", "b"], keep, hot_share=0.1, sketch_bits=bits)
        assert sorted(r.id for r in got.collect()) == want and got.columns == a.columns and got.schema["a"].dataType == a.schema["a"].dataType
    assert V.shared_rows(a, b.limit(0), ["a", "b"], False).count() == a.count() and V.shared_rows(a.limit(0), b, ["a", "b"]).count() == 0


def test_rows_the_filter_settles_do_not_move(spark, tmp_path):
    pairs(spark, 5_000, 2).write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    out = V.shared_rows(a, pairs(spark, 5_000, 2, 1), ["a", "b"], keep=False)
    assert out.count() == 5_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_maybe" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
