"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorweave.llm.common import discard, free_name, let, stage, words_of

WINDOW = 8
#: Rows that order the rules; they never decide about a document.
SAMPLE_ROWS = 300
SAMPLE_BYTES = 100_000
#: A rule runs over the sample again and again until a run takes this long, so that the job itself hardly counts.
LONG_S, MOST_REPEATS = 0.2, 8192


@dataclass(frozen=True)
class Rule:
    """A named test; ``rejects`` is a boolean column over the text (and the base columns)."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class RuleStat:
    name: str
    seconds: float
    rejected: float

    @property
    def rate(self) -> float:
        """Rejected share per second of work on a row: what the cascade sorts by.

        Costs count in powers of two, and nothing costs less than a few steps of generated code, so that rules
        that cost the same keep their order from run to run.
        """
        return self.rejected / 2.0 ** round(math.log2(max(self.seconds, 5e-8)))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by a window of ``window`` words that occurs twice or more in the array.

    Windows are told apart by the 64-bit hash of their word hashes. A text without an equal pair, the
    common case, stops after one distinct; the others sort (hash, position) pairs and sum the cover.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h):
        keys = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, window)]))
        return F.slice(keys, 1, F.size(h) - (window - 1))

    def cover(keys):
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def flagged(s):
            same = lambda x, j: F.coalesce(x["k"] == F.get(s, j)["k"], F.lit(False))
            hit = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
            return F.sort_array(F.filter(hit, lambda p: p.isNotNull()))

        def total(at):
            return F.aggregate(
                F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window)))),
                F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, flagged), total)

    counted = let(let(hashes, windows),
                  lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), cover(k)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > window, counted).otherwise(F.lit(0).cast("long"))


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``.

    A null text has no words and counts zero throughout, so it fails the base. Columns of the input
    with one of these names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words_, lines_ = free_name(df, "_words"), free_name(df, "_lines")
    df = df.withColumns({words_: words_of(F.col(text)), lines_: lines})
    df = df.withColumns({
        "n_lines": F.size(lines_).cast("long"),
        "n_words": F.size(words_).cast("long"),
        "word_chars": F.char_length(F.array_join(words_, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long"),
        "n_repeat_words": repeated_words(F.col(words_)),
    })
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.drop(words_, lines_).withColumn("base_failed", failed)


def count_of(text: Column, pattern: str) -> Column:
    """Characters of ``text`` inside the class ``pattern`` (given without brackets)."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{pattern}]+", ""))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules beside the base ones; every threshold is a share of the whole text.

    They read the base columns where these hold the count already, else the text.
    """
    t = F.col(text)
    n = F.col("n_words")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n)),
        Rule("exclamation", 10 * count_of(t, "!") > 3 * n),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("upper_case", 2 * count_of(t, r"\p{Lu}") > F.col("word_chars")),
    ]


def estimate(df: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = SAMPLE_ROWS, seed: int = 7) -> list[RuleStat]:
    """Seconds per row and selectivity of each rule on at most ``rows`` rows (the bound of the sample).

    The rows are a tenth of the first partitions that hold enough of them, so a large table is not read
    through; texts of more than ``SAMPLE_BYTES`` stay out of the sample, which bounds it. A rule runs over the sample, repeated until a run is long enough,
    and the time of a run of equal length without a rule is taken off; the least of three counts. An empty
    table gives zeros.
    """
    short = df.where(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) <= SAMPLE_BYTES)
    taken = short.sample(0.1, seed).limit(rows).collect() or short.limit(rows).collect()
    if not taken:
        return [RuleStat(r.name, 0.0, 0.0) for r in rules]
    n = len(taken)
    sample = stage(df.sparkSession.createDataFrame(taken, df.schema), "quality-sample")
    one = sample.coalesce(1)

    def run(test: Column, repeats: int) -> tuple[float, float]:
        again = one.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        hit = again.agg(F.sum(F.coalesce(test, F.lit(False)).cast("long")))
        began = time.perf_counter()
        hits = hit.first()[0]
        return time.perf_counter() - began, hits / (n * repeats)

    nothing = F.col("base_failed").isNull() if "base_failed" in df.columns else F.lit(False)
    run(nothing, 1)
    idle: dict[int, float] = {}
    out = []
    for r in rules:
        repeats = 8
        took, share = run(r.rejects, repeats)
        while took < LONG_S and repeats < MOST_REPEATS:
            repeats *= 8
            took, share = run(r.rejects, repeats)
        if repeats not in idle:
            idle[repeats] = min(run(nothing, repeats)[0] for _ in range(3))
        took = min(took, *[run(r.rejects, repeats)[0] for _ in range(2)])
        out.append(RuleStat(r.name, max(0.0, took - idle[repeats]) / (n * repeats), share))
    discard(sample)
    return out


def ordered(rules: Sequence[Rule], stats: Sequence[RuleStat]) -> list[Rule]:
    """Most rejections per second first; rules that reject nothing by their cost; ties keep the given order."""
    by = {s.name: s for s in stats}
    return sorted(rules, key=lambda r: (-by[r.name].rate, round(math.log2(max(by[r.name].seconds, 5e-8)))))


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, else null. ``CASE`` stops there: later rules are not computed."""
    out = F.lit(None).cast("string")
    for r in reversed(list(rules)):
        out = F.when(r.rejects, F.lit(r.name)).otherwise(out)
    return out


def judge(df: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """Add the base columns, ``kept`` and ``rejected_by`` to every row.

    The order of the rules changes the work and which rule is named, never ``kept``. Null, empty and
    short texts fail the base; repeated rows get equal verdicts; an empty table stays empty.
    """
    rules = default_rules(text) if rules is None else list(rules)
    based = base_columns(df, text)
    stats = estimate(based, rules, text)
    first = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered(rules, stats)))
    return based.withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns they came with."""
    names = df.columns
    tagged = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text).alias("_text"))
    return judge(tagged, "_text").where("kept").select("_row.*")
