"""URL rules found through their rarest literal token, in DataFrame functions only."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorweave.llm.common import ascii_lower, free_name, stage

#: The rule index is broadcast up to this many entries; Spark chooses the join beyond it.
BROADCAST_RULES = 50_000
_TOKEN = r"[A-Za-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """A regular expression over host and path joined, and whole tokens, in any case, that any match must hold.

    Higher ``rank`` wins, then the longer ``name``, then the larger one. ``tokens`` may be empty: such a
    rule is tried on every URL.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()
    rank: int = 0


def host_rule(name: str, verdict: str, rank: int = 1) -> UrlRule:
    """``example.net/en/``: that host and its subdomains, where the path starts with ``/en/``."""
    host, slash, rest = name.partition("/")
    path = slash + rest
    tokens = re.findall(_TOKEN, host)
    # the last token of a path prefix may go on in the URL unless a separator follows it
    tail = re.findall(_TOKEN, path)
    if tail and re.search(_TOKEN + "$", path):
        tail = tail[:-1]
    if not slash and tokens:
        tokens = tokens[:-1]
    return UrlRule(name, verdict, rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", (*tokens, *tail), rank)


def word_rule(words: str, verdict: str = "block", rank: int = 0) -> UrlRule:
    """``cheap-pills``: these tokens next to each other, with any separators between, in host or path."""
    tokens = re.findall(_TOKEN, words)
    body = r"[^A-Za-z0-9]+".join(map(re.escape, tokens))
    return UrlRule(words, verdict, rf"(?s)(?:^|[^A-Za-z0-9]){body}(?:$|[^A-Za-z0-9])", tuple(tokens), rank)


def filter_rules(lines: Iterable[str], rank: int = 0) -> tuple[list[UrlRule], list[str]]:
    """Rules from the lines of a public block list, and the lines that cannot be judged by a page's URL alone.

    ``||`` stands for the start of the host or of one of its labels, ``|`` for either end, ``^`` for a separator or the
    end, ``*`` for anything; ``/.../`` holds a regular expression; letters match in either case. ``@@`` marks an
    exception: it allows, and ranks one above the blocking lines. Host and path are matched: a scheme is left out.
    Comments, headings and blank lines give nothing. Lines with options or that hide parts of a page, and those that
    would match every URL, come back as they are.
    """
    rules, left_out = [], []
    for line in map(str.strip, lines):
        if not line or line.startswith(("!", "[")):
            continue
        allow = line.startswith("@@")
        body = line[2:] if allow else line
        raw = len(body) > 2 and body[0] == body[-1] == "/" and re.search(r"[\\^$()\[\]{}+?|]", body[1:-1])
        if not raw and (re.search(r"#[@?$%]*#", body) or "$" in body or not re.search(_TOKEN, body)):
            left_out.append(line)
            continue
        if raw:
            pattern, tokens = f"(?is){body[1:-1]}", ()
        else:
            pattern, tokens = _filter_pattern(body)
        rules.append(UrlRule(line, "allow" if allow else "block", pattern, tokens, rank + allow))
    return rules, left_out


def _filter_pattern(body: str) -> tuple[str, tuple[str, ...]]:
    """The regular expression of a block-list line, and the whole tokens any match must hold."""
    head, tail = "(?is)", ""
    if body.startswith("||"):
        head, body = "(?is)^(?:[^/]*\\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "(?is)^", re.sub(r"^[a-z]+://", "", body[1:])
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    tokens = []
    for m in re.finditer(_TOKEN, body):
        # a token is whole if a separator or an anchor is next to it on both sides
        before = body[m.start() - 1] if m.start() else ("^" if head != "(?is)" else "*")
        after = body[m.end()] if m.end() < len(body) else ("^" if tail else "*")
        if "*" not in (before, after):
            tokens.append(m.group().lower())
    parts = {"*": ".*", "^": "(?:[^A-Za-z0-9_.%-]|$)"}
    return head + "".join(parts.get(c) or re.escape(c) for c in body) + tail, tuple(tokens)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for a null and where ``://`` is missing."""
    start = F.instr(url, "://")
    rest = F.coalesce(F.when(start > 0, F.substring(url, start + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_table(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    """The rules as rows, from one literal: a rule list is the caller's, not data."""
    text = json.dumps([asdict(r) for r in rules])
    schema = "array<struct<name string, verdict string, pattern string, tokens array<string>, rank int>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), schema)))


def judge(df: DataFrame, rules: Sequence[UrlRule] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    Distinct (host, path) pairs are judged once and joined back, so a URL that fills a third of the table
    costs one row per task. Tokens of these pairs are counted for the rules' tokens alone; each rule is
    filed under its rarest one (ties: the smaller token). A pair fetches the rules filed under its tokens
    and only those run their regular expression. Without a match ``rule`` is null and ``verdict`` is
    ``default``. Null, empty and malformed URLs have an empty host and path, repeated rows get equal
    verdicts, an empty table stays empty. Input columns with the four names are replaced.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    row = free_name(df, "_row")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.col(f"`{url}`").cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.select(row, host.alias("host"), path.alias("path"))
    pairs = stage(rows.select("host", "path").distinct(), "url-pairs")
    pairs = pairs.withColumn("_target", F.concat("host", "path"))
    tokens = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("_target")), F.lit(f"({_TOKEN})"), 1))

    given = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    given = given.select("name", "verdict", "pattern", F.transform("tokens", ascii_lower).alias("tokens"), "rank")
    n_rules = given.agg(F.coalesce(F.sum(F.size("tokens") + 1), F.lit(0))).first()[0]
    small = F.broadcast if n_rules <= BROADCAST_RULES else (lambda x: x)
    keyed = given.withColumn("token", F.explode_outer("tokens"))
    wanted = keyed.select("token").where("token is not null").distinct()
    seen = (pairs.select(F.explode(tokens).alias("token")).join(small(wanted), "token")
            .groupBy("token").agg(F.count(F.lit(1)).alias("_n")))
    rarest = (keyed.join(seen, "token", "left")
              .groupBy("name", "verdict", "pattern", "rank")
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "token")).alias("_key"))
              .select("name", "verdict", "pattern", "rank", F.col("_key.token").alias("token")))
    index = stage(rarest, "url-index")

    # every pair also carries the null token, under which rules without literals are filed
    fetched = pairs.select("host", "path", "_target", F.explode(F.concat(tokens, F.array(F.lit(None).cast("string")))).alias("token"))
    hits = (fetched.join(small(index.withColumnRenamed("token", "_filed")), F.col("token").eqNullSafe(F.col("_filed")))
            .where("regexp_like(_target, pattern)"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        "rank", F.length("name").alias("long"), "name", "verdict")).alias("_best"))
    best = best.select("host", "path", F.col("_best.name").alias("rule"), F.col("_best.verdict").alias("_verdict"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(f"{row}.*", "host", "path", "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict"))
