"""Registered queries of this subpackage, with DuckDB counterparts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorweave.llm import (decontaminate, pieces, prefix_trie, pu_quality, quality, secrets, sharding, simhash,
                             substrings, toxicity, urls, warc, whitening)
from sensorweave.llm.common import table
from sensorweave.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

#: Lines of a block list: advertising and tracking, gambling, adult, pills and link spam.
URL_LINES = """
! advertising and tracking
||ad.
||ads.
||ads-
||adserver.
||adservice.
||track.
||tracker.
||tracking.
||pixel.
-ads.
-track.
-tracker.
/ads/
/adserver/
/banners/
/popunder^
@@/ads.txt|
! gambling
||bet.
||bets.
||casino.
||casino-
||jackpot-
||poker.
||poker-
||slots-
-bets.
-betting.
-casino.
-jackpot.
-poker.
/casino/
/sportsbook/
@@||responsible-gambling.
! adult
||escort-
||porn.
||porn-
||xxx.
||xxx-
-escorts.
-porn.
/porn/
! pills, followers, loans, essays
||cheap-pills.
||viagra.
||viagra-
||casino-bonus.
||free-followers.
||payday-loans.
||replica-watches.
||spam-farm.
||essay-writing*.
^cheap^pills^
^spam^farm^
""".splitlines()
#: Host rules win over the block list.
URL_RULES = [
    urls.host_rule("net/", "block"), urls.host_rule("example.net/en/", "allow"),
    urls.host_rule("example.com/de/", "block"), urls.host_rule("org/fr/", "allow"),
    *urls.filter_rules(URL_LINES, rank=-1)[0],
]
N_SHARDS = 40


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    return pieces.encode(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; a null rule means that no host rule decided."""
    out = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    host_rules = [r.name for r in URL_RULES if r.rank > 0]
    return out.select("page_id", "host", "path", F.when(F.col("rule").isin(host_rules), F.col("rule")).alias("rule"),
                      "verdict")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item; others do not come out."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest_columns(warc.round_trip(table(spark, sf_dir, "pages")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    docs = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), size.alias("size"))
    out = sharding.by_bytes(docs, ["doc_id", "text_crc32"], F.col("size"), N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 32 whitened coordinates of every embedding, one row each."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select(F.col("_row.vec_id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("node")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pu_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_url_filter, op3_simhash, op4_substrings, op5_secrets, op6_toxicity,
                            op7_quality, op8_decontamination, op9_warc, op10_sharding, op11_whitening,
                            op12_prefix_trie, op13_quality_classifier, pipeline)}
