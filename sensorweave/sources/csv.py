"""CSV sources and sinks, zones, and time-column detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZONES = ("raw", "interim", "processed")

# Fixed value: the text form of a time column.
TIME_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def zone_path(root: str, zone: str, name: str) -> str:
    """Place of a table in one of the zones raw, interim, processed."""
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone}")
    return f"{root.rstrip('/')}/{zone}/{name}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, *, header: bool = True,
             separator: str = ",", names: Sequence[str] | None = None, detect_time: bool = False) -> DataFrame:
    """Read CSV with an explicit schema (S1); without a header, ``names`` may rename the columns.

    Spaces around values are ignored and empty fields are null.
    """
    reader = (spark.read.schema(schema).option("sep", separator).option("header", header)
              .option("timestampNTZFormat", TIME_FORMAT)
              .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True))
    df = reader.csv(path)
    if names is not None:
        df = df.toDF(*names)
    return detect_time_column(df) if detect_time else df


def find_csv(spark: SparkSession, root: str, name: str, schema: T.StructType | str, **options) -> DataFrame:
    """Read the files called ``name`` anywhere below ``root`` (S3)."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    return reader.options(**{"header": True, "timestampNTZFormat": TIME_FORMAT, **options}).csv(root)


def write_csv(df: DataFrame, path: str, *, header: bool = True, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write CSV, one folder per segment instead of one file per segment when partitioned."""
    writer = df.write.mode(mode).option("header", header).option("timestampNTZFormat", TIME_FORMAT)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_parquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write Parquet; rows are clustered by the partition columns first, to avoid many small files."""
    if partition_by:
        # The salt keeps one large segment from being written by a single task.
        rest = [c for c in df.columns if c not in partition_by]
        df = df.repartition(*partition_by, F.pmod(F.xxhash64(*rest), F.lit(8)))
        df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def detect_time_column(df: DataFrame, out: str = "datetime") -> DataFrame:
    """Find the text column whose every value looks like a time, parse it and call it ``datetime``.

    One pass over the text columns (runs a job). A null blocks detection. Without a match ``df``
    comes back unchanged.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    row = df.agg(*[F.bool_and(F.coalesce(F.col(c).rlike(TIME_PATTERN), F.lit(False))).alias(c) for c in texts]).first()
    for c in texts:
        if row[c]:
            parsed = F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
            return df.select(*[parsed.alias(out) if x == c else F.col(x) for x in df.columns])
    return df


def attach_predictions(actual: DataFrame, predicted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Actual and predicted values side by side, matched by key and never by position."""
    return actual.join(predicted, list(key))
