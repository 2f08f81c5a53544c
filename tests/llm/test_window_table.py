"""The bit table of item windows: no wanted window is lost, few others pass, and the result stays."""

import numpy as np
from pyspark.sql import functions as F

from sensorweave.llm import decontaminate as D


def test_table_holds_every_hash(spark):
    rng = np.random.default_rng(3)
    hashes = np.concatenate([rng.integers(0, 2 ** 64, 3000, dtype=np.uint64), np.array([0, 2 ** 64 - 1, 2 ** 63], np.uint64)])
    table = D.packed_table(spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "hash long"))
    assert table.nbytes == 2 ** D.TABLE // 8 and D.held(table, hashes).all()
    assert D.held(table, rng.integers(0, 2 ** 64, 100_000, dtype=np.uint64)).mean() < 1e-3


def test_few_windows_pass_and_long_texts_come_in_blocks(spark, monkeypatch):
    item = "what is the height of the tower that stands near Lake Orta in metres if it has 12 floors"
    texts = [item, "some other words entirely " * 400, item.replace("12", "15") + " more", None, "", " ".join(f"w{i}" for i in range(150_000)) + " " + item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    index = D._windows(items, "item_id", "text", D.Params(), (), True, None)
    passed = D._windows(docs, "doc_id", "text", D.Params(), (8,), False, D.packed_table(index))
    assert passed.where("doc_id = 1").count() == 0 and passed.where("doc_id = 5").count() < 100
    got = [sorted(map(tuple, D.matches(docs, items, p=D.Params(filter_windows=n)).collect())) for n in (0, 10 ** 6)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [0, 2, 5]
    assert D._windows(docs.where("doc_id = 5"), "doc_id", "text", D.Params(), (8,), False, None).where(F.size("slots") == 0).count() == len(D.tokens_of(texts[5])) - 7
