"""How a table describes its series: which columns identify one, and which order it."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY_MICROS = 86_400 * MICROS


@dataclass(frozen=True)
class SeriesSpec:
    """Names of the columns that give a series its identity and its order.

    ``keys`` identify a series (they may be empty: the table is then one series), ``ts`` orders its
    rows, ``tiebreak`` orders rows with equal ``ts``. Tables on a regular grid also carry ``slot``,
    the 0-based grid index inside the series, and ``chunk``, a coarse bucket of the slot that
    bounds how many rows one task sorts. ``packed`` says that the first key is a struct of all keys.

    ``levels`` of the scans that carry facts from chunk to chunk and from time cell to time cell (``ordered.carry``): 1
    orders a series' summary rows in one window, 2 and more bound that window for series of billions of rows, at
    the price of a small join per level. The results are the same.
    """

    keys: tuple[str, ...] = ()
    ts: str = "ts"
    tiebreak: tuple[str, ...] = ()
    slot: str = "slot"
    chunk: str = "chunk_id"
    packed: bool = False
    levels: int = 1

    def within(self, *names: str) -> "SeriesSpec":
        """The same series cut further by ``names`` (segments, days, folds)."""
        extra = tuple(n for n in names if n not in self.keys)
        return replace(self, keys=self.keys + extra)

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.tiebreak]


#: Groups as one column. The struct itself is never null, so joins on it keep null groups.
SERIES = "_series"


def pack(df: DataFrame, keys: Sequence[str], name: str = SERIES) -> DataFrame:
    """Replace the key columns by one struct of them, equal where the keys are equal or both null."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    return df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias(name), *rest)


def unpack(df: DataFrame, keys: Sequence[str], name: str = SERIES) -> DataFrame:
    """Undo ``pack``; the key columns come first."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*[F.col(f"`{name}`.`{k}`").alias(k) for k in keys], *rest)


def null_safe(op: Callable | None = None, *, unless: str | None = None):
    """Let an operator ``op(df, spec, ...)`` that joins on the series keys keep rows whose keys are null.

    Its tables are packed before and unpacked after; operators it calls see the packed key and leave it
    as it is, so the shuffles they share stay shared. A call that passes the argument ``unless`` hands
    over a partitioning of its own and is not packed.
    """
    if op is None:
        return lambda f: null_safe(f, unless=unless)
    names = inspect.signature(op)

    @wraps(op)
    def run(df: DataFrame, spec: SeriesSpec, *args, **kwargs) -> DataFrame:
        given = names.bind(df, spec, *args, **kwargs).arguments
        if not spec.keys or spec.packed or given.get(unless) is not None:
            return op(df, spec, *args, **kwargs)
        keys = list(spec.keys)
        given = {n: pack(v, keys, keys[0]) if isinstance(v, DataFrame) else v for n, v in given.items() if n != "options"}
        options = names.bind(df, spec, *args, **kwargs).arguments.get("options", {})
        out = op(**{**given, "spec": replace(spec, keys=(keys[0],), packed=True)}, **options)
        return unpack(out, keys, keys[0])

    return run


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch; the session time zone must be UTC (see ``configure``)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def from_micros(t: Column) -> Column:
    return F.timestamp_micros(t).cast("timestamp_ntz")


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the library relies on. Safe to call more than once."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Joins on (series, chunk) must shuffle by both: by series alone, a long series meets in one task.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
