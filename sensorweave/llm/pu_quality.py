"""Text quality from trusted positives and unlabelled texts: non-negative positive-unlabelled risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sensorweave.llm.common import discard, stage

FOLDS, HELD = 5, 0
#: Byte classes whose share of a text is a feature.
CLASSES = {"upper": bytes(range(65, 91)), "digit": b"0123456789", "exclaim": b"!", "question": b"?", "bar": b"|", "marks": b"#$%&*^~`",
           "stop": b".", "comma": b",;:", "quote": b"\"'", "bracket": b"()[]{}", "tag": b"<>/\\", "sign": b"@=+_-"}
NAMES = (*CLASSES, "lines", "blank", "twins", "pairs", "words", "top", "repeated_lines", "mean_word", "long_word", "short_words",
         "capitalised", "log_words")


@dataclass(frozen=True)
class Params:
    """``ridge`` on the weights of standardised features, ``rounds`` passes at most, ``bins`` of the prior's score
    histogram, ``delta``: how sure the bound on a bin's share shall be."""

    ridge: float = 1e-3
    rounds: int = 30
    bins: int = 512
    delta: float = 0.1


_TABLE = np.zeros((len(CLASSES), 256), bool)
for _i, _c in enumerate(CLASSES.values()):
    _TABLE[_i, list(_c)] = True


def features(text: str | None) -> np.ndarray:
    """Shares and rates of a whole text on a log scale, in the order of ``NAMES``; zeros for a text without words."""
    raw = (text or "").encode()
    words = (text or "").split()
    if not words:
        return np.zeros(len(NAMES))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(words)
    seen = Counter(words)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    few = max(n - 1, 1)
    shares = [*(_TABLE @ counts / n),
              (counts[10] + 1) / n, 1 - len(lines) / (counts[10] + 1),
              sum(a == b for a, b in zip(words, words[1:])) / few, 1 - len(set(zip(words, words[1:]))) / few,
              len(seen) / n, max(seen.values()) / n, 1 - len(set(lines)) / max(len(lines), 1),
              sizes.mean(), sizes.max() / 10, float((sizes <= 1).mean()), sum(w[0].isupper() for w in words) / n]
    return np.array([*np.log1p(10 * np.array(shares)), np.log1p(n)])


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Constant, standardised features within four deviations, and their squares."""
    z = np.clip((x - mean) / scale, -4, 4)
    return np.column_stack([np.ones(len(z)), z, z * z - 1])


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``df`` but the text, and ``x``: its features."""
    rest = [c for c in df.columns if c != text]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = StructType([*rows.drop("_text").schema.fields, StructField("x", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([features(t.as_py()) for t in b.column("_text")]).reshape(-1, len(NAMES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, len(NAMES), dtype=np.int32)), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], lists], names=[*rest, "x"])

    return rows.mapInArrow(run, schema)


def _summed(rows: DataFrame, make, size: int) -> np.ndarray:
    """Sum over tasks of ``make(x, positive, half)`` over the batches; a fixed number of cells reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                out += make(x, b.column("positive").to_numpy(zero_copy_only=False), b.column("half").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out)], names=["cell", "v"])

    got = rows.select("x", "positive", "half").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got["cell"].to_numpy()] = got["v"].to_numpy()
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Moments:
    """Sums at the present weights over unlabelled texts (``u_``) and trusted positives (``p_``), as means."""

    loss_u: float  # softplus(z): the loss of calling an unlabelled text negative
    grad_u: np.ndarray
    curve_u: np.ndarray
    loss_p: float  # softplus(z) of positives
    pull_p: float  # softplus(-z): the loss of calling a positive positive
    grad_p: np.ndarray
    mean_p: np.ndarray


def moments(rows: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray, half: int | None = None) -> Moments:
    """One pass. ``half`` takes the positives of that half alone."""
    d = len(w)
    cuts = np.cumsum([1, 1, d, d * d, 1, 1, 1, d, d])

    def make(x: np.ndarray, positive: np.ndarray, halves: np.ndarray) -> np.ndarray:
        e = expanded(x, mean, scale)
        p = positive == 1 if half is None else (positive == 1) & (halves == half)
        z = e @ w
        s, up = _sigmoid(z), np.logaddexp(0, z)
        return np.concatenate([
            [len(x)], [up.sum()], e.T @ s, ((e * (s * (1 - s))[:, None]).T @ e).ravel(),
            [p.sum()], [up[p].sum()], [np.logaddexp(0, -z[p]).sum()], e[p].T @ s[p], e[p].sum(axis=0)])

    n_u, loss_u, grad_u, curve, n_p, loss_p, pull_p, grad_p, mean_p = np.split(_summed(rows, make, int(cuts[-1])), cuts[:-1])
    u, p = max(n_u[0], 1), max(n_p[0], 1)
    return Moments(loss_u[0] / u, grad_u / u, curve.reshape(d, d) / u, loss_p[0] / p, pull_p[0] / p, grad_p / p, mean_p / p)


def fit(rows: DataFrame, prior: float, mean: np.ndarray, scale: np.ndarray, p: Params = Params(), half: int | None = None) -> np.ndarray:
    """Weights of least non-negative risk  prior E_p[l(z)] + max(0, E_u[l(-z)] - prior E_p[l(-z)])  with log loss.

    Newton steps, one pass over all texts each. Where the negative part falls below zero, which only an
    overfit can do, the step goes up its gradient instead. The weights of the least risk seen are returned.
    """
    d = 1 + 2 * len(mean)
    w = np.zeros(d)
    keep = np.full(d, p.ridge)
    keep[0] = 0
    best, least, shrink = w, np.inf, 1.0
    for _ in range(p.rounds):
        m = moments(rows, w, mean, scale, half)
        negative = m.loss_u - prior * m.loss_p
        risk = prior * m.pull_p + max(negative, 0.0) + float(keep @ (w * w)) / 2
        curve = m.curve_u + np.diag(keep + 1e-9)
        if risk < least - 1e-7:
            best, least, shrink = w, risk, min(1.0, 2 * shrink)
        elif shrink < 1e-2:
            break
        else:  # worse than before: shorter steps from the best place
            shrink /= 4
            w = best + (w - best) / 4
            continue
        slope = -prior * m.mean_p + m.grad_u + keep * w if negative >= 0 else -(m.grad_u - prior * m.grad_p)
        step = np.linalg.solve(curve, slope)
        if negative >= 0 and np.abs(slope @ step) < 1e-8:
            break
        longest = max(1.0, float(np.abs(step).max()) / 4)
        w = w - shrink * step / longest
    return best


def class_prior(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, p: Params = Params()) -> float:
    """Share of positives among all texts, from positives and unlabelled texts alone.

    A model of one half of the positives against all texts scores the other half. Above every threshold the
    share of all texts is at least the prior times the share of positives, so the smallest ratio of the two,
    over thresholds with positives enough for a small error, estimates the prior from above.
    """
    w = fit(rows, 0.5, mean, scale, p, half=0)

    def make(x: np.ndarray, positive: np.ndarray, halves: np.ndarray) -> np.ndarray:
        at = np.minimum((_sigmoid(expanded(x, mean, scale) @ w) * p.bins).astype(np.int64), p.bins - 1)
        other = (positive == 1) & (halves == 1)
        return np.concatenate([np.bincount(at, minlength=p.bins), np.bincount(at[other], minlength=p.bins)])

    every, other = np.split(_summed(rows, make, 2 * p.bins), 2)
    if not other.sum():
        return 0.5
    above_u, above_p = (np.cumsum(c[::-1])[::-1] / c.sum() for c in (every, other))
    slack = np.sqrt(np.log(4 / p.delta) / 2) * (1 / np.sqrt(every.sum()) + 1 / np.sqrt(other.sum()))
    wide = above_p > max(0.05, slack)
    bound = (above_u + slack) / np.maximum(above_p, 1e-12)
    best = np.flatnonzero(wide)[np.argmin(bound[wide])]
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          p: Params = Params()) -> DataFrame:
    """``key``, ``held_out``, ``score`` (0 to 1) and ``prior`` of every row of ``docs``.

    Trusted positives are texts whose labels are 1 (half of them or more, if a text has several), taken from rows
    with crc32(key as text) mod 5 other than 0; other labels are not read: those texts are unlabelled like all.
    Equal texts count once in the risk. Scores depend on the text alone; null and empty texts have zero
    features; a null key is not held out and has no label; repeated rows get equal scores. Without positives
    every score is 0.5. An empty table gives no rows.
    """
    spark = docs.sparkSession
    t = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("h1"),
                       F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("h2"), t.alias("text"))
    seen = stage(with_features(rows, "text"), "quality-features")
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("double").alias("y"))
    known = known.where(F.col("y").isNotNull() & (_fold(F.col("key")) != HELD)).groupBy("key").agg(F.avg("y").alias("y"))
    # a text or a key may fill a third of the rows: both are aggregated before they are joined
    named = seen.groupBy("h1", "h2", "key").agg(F.lit(1).alias("_one")).join(known, "key").groupBy("h1", "h2").agg(F.avg("y").alias("y"))
    once = seen.groupBy("h1", "h2").agg(F.first("x").alias("x")).join(named, ["h1", "h2"], "left")
    train = stage(once.select("x", F.when(F.col("y") >= 0.5, 1).otherwise(0).alias("positive"),
                              F.pmod("h1", F.lit(2)).cast("int").alias("half")), "quality-train")
    stats = train.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()  # one row per feature
    held = F.coalesce(_fold(F.col("key")) == HELD, F.lit(False)).alias("held_out")
    if not train.where("positive = 1").head(1):
        return seen.select(F.col("key").alias(key), held, F.lit(0.5).alias("score"), F.lit(0.5).alias("prior"))
    mean, scale = np.array([r.m for r in stats]), np.array([r.s if r.s > 1e-9 else 1.0 for r in stats])
    prior = class_prior(train, mean, scale, p)
    w = fit(train, prior, mean, scale, p)
    discard(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(_sigmoid(expanded(x, mean, scale) @ w))], names=["key", "score"])

    schema = StructType([seen.schema["key"], StructField("score", DoubleType())])
    scored = seen.select("key", "x").mapInArrow(run, schema)
    return scored.select(F.col("key").alias(key), held, "score", F.lit(prior).alias("prior"))
