"""Toxicity from two Kneser-Ney models, one for toxic and one for ordinary texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from xxhash import xxh64_intdigest

from sensorweave.llm.common import discard, stage

WORD = re.compile(r"\w+")
SEED = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
FEATURES = ("mean", "strong", "stronger", "length")


@dataclass(frozen=True)
class Params:
    """``discount`` is taken from every class count of a word or pair (classes scaled to equal mass); word
    evidence above each of the ``strong`` nats is also averaged by itself. ``fit_rows`` bounds the labelled
    rows that set the weights of the score. The label table and the model are sent to all tasks up to
    ``broadcast_rows`` and ``model_rows`` rows, and joined beyond, with equal results."""

    discount: float = 3.0
    strong: tuple[float, float] = (1.5, 2.5)
    fit_rows: int = 20_000
    broadcast_rows: int = 2_000_000
    model_rows: int = 4_000_000


class _Hashes(dict):
    """Word to 64-bit hash, remembered for up to ``limit`` different words."""

    limit = 200_000

    def __missing__(self, word: str) -> int:
        code = xxh64_intdigest(word, SEED)
        if len(self) >= self.limit:
            self.clear()
        self[word] = code
        return code


def hashes(text: str | None, cache: _Hashes) -> np.ndarray:
    """Hashes of the empty word, which starts every text, and of its words."""
    words = WORD.findall((text or "").lower())
    full = np.empty(len(words) + 1, np.uint64)
    full[0] = cache[""]
    full[1:] = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    return full


def pair_key(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (left * MIX ^ word) * MIX


def _count(rows: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Word ``w`` after word ``v``, with its ordinary and toxic count in some ``chunk`` words of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        held: list[tuple[np.ndarray, int]] = []

        def counted() -> pa.RecordBatch:
            v = np.concatenate([h[:-1] for h, _ in held])
            w = np.concatenate([h[1:] for h, _ in held])
            toxic = np.repeat([c for _, c in held], [len(h) - 1 for h, _ in held])
            _, at, back = np.unique(pair_key(v, w), return_index=True, return_inverse=True)
            n, t = np.bincount(back, minlength=len(at)), np.bincount(back, toxic, minlength=len(at)).astype(np.int64)
            return pa.RecordBatch.from_pydict({"v": v[at].view(np.int64), "w": w[at].view(np.int64), "o": n - t, "t": t})

        size = 0
        for b in batches:
            for text, toxic in zip(b.column("text"), b.column("toxic")):
                h = hashes(text.as_py(), cache)
                if len(h) > 1:
                    held.append((h, int(toxic.as_py())))
                    size += len(h)
                if size > chunk:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return rows.mapInArrow(run, "v long, w long, o long, t long")


@dataclass
class Model:
    """Evidence for toxic, in nats: log P(word | word before, toxic) - log P(the same | ordinary).

    It is the sum of the evidence of the word alone (``rest``, or ``word`` more), that of the backoff weights of
    the word before (``left``) and that of the pair itself. Words and pairs with no count above the discount in
    either class need no row: what they add is in the two other parts.
    """

    words: DataFrame  # key, word, left
    pairs: DataFrame  # key, pair
    rest: float


def learn(rows: DataFrame, p: Params = Params()) -> Model | None:
    """Both models from ``text`` and ``toxic`` (0 or 1); none unless both classes have words.

    Every pair of adjacent words of all rows is counted by its 64-bit hashes, per task first, so the model
    grows with the corpus. Class counts are scaled to equal mass; a class takes ``discount`` from each count.
    What a context's pairs free goes to the word distribution of the class, and what the words free goes to
    one distribution both share: all counts, backed off to the number of different words before a word. So
    both classes have proper distributions, and what neither has seen often enough speaks for neither.
    """
    counted = _count(rows).groupBy("v", "w").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
    pairs = stage(counted, "toxicity-pairs")
    n_o, n_t, n_pairs = pairs.agg(F.sum("o"), F.sum("t"), F.count(F.lit(1))).first()
    if not n_o or not n_t:
        return None
    mass = min(n_o, n_t)
    classes = {"o": mass / n_o, "t": mass / n_t}

    def count(c: str) -> Column:
        return F.col(c) * F.lit(classes[c])

    def kept(c: str) -> Column:
        return F.greatest(count(c) - p.discount, F.lit(0.0))

    words = stage(pairs.groupBy("w").agg(F.sum("o").alias("o"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("before")), "toxicity-words")
    freed_o, freed_t, n_words = words.agg(*[F.sum(F.least(count(c), F.lit(p.discount))) / mass for c in classes], F.count(F.lit(1))).first()
    pooled, d0 = F.col("o") + F.col("t"), 0.75
    shared = (F.greatest(pooled - d0, F.lit(0.0)) + d0 * n_words * F.col("before") / n_pairs) / (n_o + n_t)
    words = words.select("w", *[(kept(c) / mass + f * shared).alias(f"p_{c}") for c, f in (("o", freed_o), ("t", freed_t))],
                         ((kept("o") > 0) | (kept("t") > 0)).alias("often"))
    contexts = pairs.groupBy("v").agg(*[F.sum(count(c)).alias(f"n_{c}") for c in classes], *[F.sum(kept(c)).alias(f"kept_{c}") for c in classes])
    contexts = stage(contexts.where("kept_o > 0 or kept_t > 0").select("v", "n_o", "n_t", *[
        F.when(F.col(f"n_{c}") > 0, 1 - F.col(f"kept_{c}") / F.col(f"n_{c}")).otherwise(1.0).alias(f"back_{c}") for c in classes]), "toxicity-contexts")
    word, left = F.log(F.col("p_t") / F.col("p_o")), F.log(F.col("back_t") / F.col("back_o"))
    rest = float(np.log(freed_t / freed_o))
    known = words.where("often").join(contexts, F.col("w") == F.col("v"), "full").select(
        F.coalesce("w", "v").alias("key"), F.coalesce(word - rest, F.lit(0.0)).alias("word"), F.coalesce(left, F.lit(0.0)).alias("left"))

    def given(c: str) -> Column:
        return F.when(F.col(f"n_{c}") > 0, F.col(f"k_{c}") / F.col(f"n_{c}")).otherwise(0.0) + F.col(f"back_{c}") * F.col(f"p_{c}")

    often = pairs.select("v", "w", *[kept(c).alias(f"k_{c}") for c in classes]).where("k_o > 0 or k_t > 0")
    often = often.join(contexts, "v").join(words, "w").select("v", "w", (F.log(given("t") / given("o")) - word - left).alias("pair"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, w = (b.column(c).to_numpy().view(np.uint64) for c in ("v", "w"))
            yield pa.RecordBatch.from_arrays([pa.array(pair_key(v, w).view(np.int64)), b.column("pair")], names=["key", "pair"])

    out = Model(stage(known, "toxicity-model-words"), stage(often.mapInArrow(keyed, "key long, pair double"), "toxicity-model-pairs"), rest)
    for staged in (pairs, contexts):
        discard(staged)
    return out


class _Lookup:
    """Values of 64-bit keys, zero for others."""

    def __init__(self, table: pa.Table):
        key = table["key"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.key = key[order]
        self.values = [table[c].to_numpy()[order] for c in table.column_names[1:]]

    def __call__(self, key: np.ndarray) -> list[np.ndarray]:
        if not len(self.key):
            return [np.zeros(len(key)) for _ in self.values]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return [np.where(hit, v[at], 0.0) for v in self.values]


def _by_broadcast(out: DataFrame, model: Model, p: Params) -> DataFrame:
    """Features of every row, ``text`` dropped, with the model in every task."""
    shared = out.sparkSession.sparkContext.broadcast((_Lookup(model.words.toArrow()), _Lookup(model.pairs.toArrow())))
    rest, names = model.rest, [c for c in out.columns if c != "text"]

    def features(text: str | None, cache: _Hashes) -> tuple[float, ...]:
        h = hashes(text, cache)
        n = len(h) - 1
        if not n:
            return (0.0,) * len(FEATURES)
        words, pairs = shared.value
        word, left = words(h)
        total = (word[1:] + rest).sum() + left[:-1].sum() + pairs(pair_key(h[:-1], h[1:]))[0].sum()
        alone = word[1:] + rest
        return (total / n, *[alone[alone > x].sum() / n for x in p.strong], float(np.log1p(n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for b in batches:
            made = np.array([features(t.as_py(), cache) for t in b.column("text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *[pa.array(made[:, i]) for i in range(len(FEATURES))]],
                                             names=[*names, *FEATURES])

    return out.mapInArrow(run, StructType(out.drop("text").schema.fields + [StructField(f, DoubleType()) for f in FEATURES]))


def _by_join(out: DataFrame, model: Model, p: Params) -> DataFrame:
    """The same by joins of (text, expression) with the model; equal texts are counted once, by a digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for b in batches:
            for i, text in enumerate(b.column("text")):
                h = hashes(text.as_py(), cache)
                if len(h) == 1:
                    continue
                key, at = np.unique(h, return_inverse=True)
                two, n_two = np.unique(pair_key(h[:-1], h[1:]), return_counts=True)
                n = len(key) + len(two)
                as_word, as_left = np.bincount(at[1:], minlength=len(key)), np.bincount(at[:-1], minlength=len(key))
                yield pa.RecordBatch.from_arrays([
                    pa.array([b.column("text_id")[i].as_py()] * n, b.schema.field("text_id").type), pa.array(np.repeat([False, True], [len(key), len(two)])),
                    pa.array(np.concatenate([key, two]).view(np.int64)), pa.array(np.concatenate([as_word, n_two])),
                    pa.array(np.concatenate([as_left, np.zeros(len(two), np.int64)]))], names=["text_id", "two", "key", "n", "n_left"])

    named = out.withColumn("text_id", F.concat_ws(":", F.xxhash64("text"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.length("text")))
    grams = (named.select("text_id", "text").mapInArrow(run, "text_id string, two boolean, key long, n long, n_left long")
             .groupBy("text_id", "two", "key").agg(F.max("n").alias("n"), F.max("n_left").alias("n_left")))
    both = model.words.select(F.lit(False).alias("two"), "key", F.col("word").alias("value"), "left").union(
        model.pairs.select(F.lit(True), "key", "pair", F.lit(0.0)))
    value, rest, one = F.coalesce("value", F.lit(0.0)), F.lit(model.rest), ~F.col("two")
    alone = value + rest
    sums = grams.join(both, ["two", "key"], "left").groupBy("text_id").agg(
        F.sum(F.when(one, F.col("n"))).alias("_n"), F.sum(F.col("n") * F.when(one, alone).otherwise(value) + F.col("n_left") * F.coalesce("left", F.lit(0.0))).alias("_all"),
        *[F.sum(F.when(one & (alone > x), F.col("n") * alone).otherwise(0.0)).alias(f"_{i}") for i, x in enumerate(p.strong)])
    made = [F.col("_all") / F.col("_n"), *[F.col(f"_{i}") / F.col("_n") for i in range(len(p.strong))], F.log1p("_n")]
    return named.drop("text").join(sums, "text_id", "left").select(
        *[c for c in out.columns if c != "text"], *[F.coalesce(v, F.lit(0.0)).alias(f) for f, v in zip(FEATURES, made)])


def weights(features: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Logistic weights, the constant first, by Newton steps on a few thousand rows."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (q - toxic) + ridge * w)
        w -= step
    return w


def _fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(4))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          p: Params = Params()) -> DataFrame:
    """``key``, ``held_out``, ``score`` and the features of every row.

    Labels are used of rows with crc32(key as text) mod 4 other than 2: folds 0 and 1 train the models, at
    most ``fit_rows`` rows of fold 3 weigh the features. Equal texts train once, toxic if half of their
    labels say so. The score reads the text alone. Null and empty texts have zero features; a null key is
    not held out and has no label; repeated rows get equal scores. Where the labels lack a class, every
    score is the share of toxic labels (0 without labels).
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("double").alias("toxic"))
    known = stage(known.where("toxic is not null").where(_fold(F.col("key")) != 2), "toxicity-labels")
    n_known = known.count()
    small = F.broadcast if n_known <= p.broadcast_rows else (lambda x: x)
    digest = F.struct(F.xxhash64("text").alias("a"), F.crc32(F.coalesce("text", F.lit(""))).alias("b"), F.length("text").alias("c"))
    train = (rows.select("key", digest.alias("digest")).join(small(known), "key").groupBy("digest")
             .agg(F.min("key").alias("key"), F.avg("toxic").alias("toxic"))
             .select("key", (F.col("toxic") >= 0.5).cast("int").alias("toxic"), _fold(F.col("key")).alias("fold")))
    train = stage(train, "toxicity-train")
    base = train.agg(F.avg("toxic")).first()[0] or 0.0
    first = train.where("fold < 2").select("key", "toxic")
    model = learn(rows.join(small(first), "key").select("text", "toxic"), p)
    out = rows.select("key", _fold(F.col("key")).alias("_fold"), "text")
    held = F.coalesce(F.col("_fold") == 2, F.lit(False))
    if model is None:
        return out.select(F.col("key").alias(key), held.alias("held_out"), F.lit(float(base)).alias("score"),
                          *[F.lit(0.0).alias(f) for f in FEATURES])
    fits = model.words.count() + model.pairs.count() <= p.model_rows
    seen = stage((_by_broadcast if fits else _by_join)(out, model, p), "toxicity-features")
    fit = (seen.join(small(train.where("fold = 3").select("key", "toxic")), "key").select(*FEATURES, "toxic")
           .limit(p.fit_rows).toPandas())
    if fit["toxic"].nunique() < 2:
        w = np.array([0.0, 1.0] + [0.0] * (len(FEATURES) - 1))
    else:
        w = weights(fit[list(FEATURES)].to_numpy(), fit["toxic"].to_numpy())
    z = F.lit(float(w[0]))
    for f, v in zip(FEATURES, w[1:]):
        z = z + F.col(f) * F.lit(float(v))
    value = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    return seen.select(F.col("key").alias(key), held.alias("held_out"), value.alias("score"), *FEATURES)
