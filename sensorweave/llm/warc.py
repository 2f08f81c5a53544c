"""Content-addressed WARC archive: payloads once by digest, record headers apart, records by join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorweave.sources.stage import new_path

_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    """Folders of one archive below ``root``."""

    root: str

    @property
    def payloads(self) -> str:
        return f"{self.root}/payloads"

    @property
    def records(self) -> str:
        return f"{self.root}/records"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32 (32 characters, no padding): five hex digits are four base32 ones."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _headers(kind: Column, page_id: Column, url: Column, digest: Column, refers_to: Column, length: Column) -> Column:
    """The header block of a record, up to and with its empty line. Line ends inside a URL become %0D and %0A."""
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">\r\n"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record(page_id),
        F.lit("WARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha1:"), digest, F.lit("\r\n"),
        F.when(revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            record(refers_to))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.when(revisit, F.lit("0")).otherwise(length.cast("string")), F.lit("\r\n\r\n"))


def write(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", html: str = "html",
          min_revisit_bytes: int = 0) -> Archive:
    """Write one record per row; equal payloads are stored once.

    A payload is the text in UTF-8 (null: empty) and is filed under its SHA-256. Before a payload is
    shared, all rows under the digest must agree in length, SHA-1 and XXH64, else the write fails. Of
    records with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest key is a
    response and the others revisit it; smaller payloads are all responses. A null key is smaller than
    any other; rows that share the largest key, repeated rows too, are all responses.
    """
    archive = Archive(root)
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    rows = rows.select("key", "url", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"),
                       F.octet_length("payload").cast("long").alias("bytes"), F.xxhash64("payload").alias("check"), "payload")
    slim = rows.drop("payload")

    # partial aggregates meet per digest: a payload of a third of all pages is one row per task
    once = rows.groupBy("sha256").agg(
        F.first("payload").alias("payload"), F.first("sha1").alias("sha1"), F.first("bytes").alias("bytes"),
        F.max("key").alias("newest"),
        ((F.min("sha1") == F.max("sha1")) & (F.min("bytes") == F.max("bytes")) & (F.min("check") == F.max("check"))).alias("same"))
    once = once.withColumn("verified", F.when(F.col("same"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("payloads differ under digest "), "sha256")).cast("boolean")))
    once.drop("same").write.option("compression", "zstd").mode("overwrite").parquet(archive.payloads)

    spark = pages.sparkSession
    owners = spark.read.parquet(archive.payloads).select("sha256", "newest")
    joined = slim.drop("check").join(owners, "sha256")
    response = (F.col("bytes") < min_revisit_bytes) | F.col("key").eqNullSafe(F.col("newest"))
    kind = F.when(response, F.lit("response")).otherwise(F.lit("revisit"))
    joined.select("key", "sha256", _headers(
        kind, F.col("key"), F.col("url"), F.col("sha1"), F.col("newest"), F.col("bytes")).cast("binary").alias("header")
    ).write.option("compression", "zstd").mode("overwrite").parquet(archive.records)
    return archive


def field(header: Column, name: str) -> Column:
    """Value of a header line, null where it is missing."""
    found = F.regexp_extract(header.cast("string"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """Records as written: ``key``, ``header``, ``payload``, and ``record``, the bytes of the whole WARC record.

    ``payload`` is the full payload of revisits too; ``record`` holds it for responses only. Payloads are
    digested again; one that does not fit its name fails the read.
    """
    stored = spark.read.parquet(archive.payloads).select("sha256", "payload")
    intact = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), "sha256")).cast("binary"))
    records = spark.read.parquet(archive.records)
    out = records.join(stored.select("sha256", intact.alias("payload")), "sha256")
    own = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return out.select("key", "header", "payload", F.concat("header", own, F.lit(b"\r\n\r\n")).alias("record"))


def round_trip(pages: DataFrame, label: str = "warc", **options) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    spark = pages.sparkSession
    return read(spark, write(pages, new_path(spark, label), **options))


def parts(record: Column) -> tuple[Column, Column]:
    """Header block (with its empty line) and body of a whole record."""
    head = F.concat(F.substring_index(record.cast("string"), "\r\n\r\n", 1), F.lit("\r\n\r\n"))
    size = F.octet_length(head)
    return head, F.substring(record, size + 1, F.octet_length(record) - size - 4)


def digest_columns(records: DataFrame) -> DataFrame:
    """One row per record, taken from the rebuilt bytes of the record.

    ``record_sha256`` is the digest of all its bytes. The read fails where a record's parts do not fit: a body
    that is not as long as its header says, or a response that does not have the digest its header names.
    Only the payload of a revisit, which its record does not hold, comes from the join.
    """
    head, body = parts(F.col("record"))
    rows = records.select(F.col("key").alias("page_id"), head.alias("head"), body.alias("body"), "payload", "record")
    header = F.col("head")
    kind, digest = field(header, "WARC-Type"), F.substring(field(header, "WARC-Payload-Digest"), 6, 32)
    whole = F.when(kind == "revisit", F.col("payload")).otherwise(F.col("body"))
    fits = (field(header, "Content-Length").try_cast("long") == F.octet_length("body")) & (base32_sha1(whole) == digest)
    refers = F.regexp_extract(field(header, "WARC-Refers-To"), r"<urn:page:(.*)>", 1)
    return rows.select(
        "page_id", F.octet_length(whole).cast("long").alias("payload_bytes"),
        F.when(fits, digest).otherwise(F.raise_error(F.concat(F.lit("damaged record "), header))).alias("payload_digest"),
        kind.alias("record_type"), refers.try_cast("long").alias("refers_to"), F.sha2("record", 256).alias("record_sha256"))
