"""Secrets in texts: fixed patterns, and random strings that a tokenizer cannot compress."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sensorweave.llm.common import tokenizer_file

#: The patterns of the base kinds, in the order that breaks ties.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")  # the matches of HEX that are long enough: a run is taken whole
KINDS = ("assign", "access", "hex", "random")
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Fixed value: how the rank files' vocabularies cut text before they merge.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}(?![A-Za-z0-9+/_=-])"
#: What is no secret though it looks random: digests by their length, UUIDs, numbers.
DIGEST = re.compile(r"(?:sha(?:1|224|256|384|512)[-_:=]?|md5[-_:=]?)?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}"
                    r"|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})|sha(?:1|224|256|384|512)-[A-Za-z0-9+/]+={0,2}")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
NUMBER = re.compile(r"[0-9+/_=-]+")
#: Letters, and groups of letters or of digits: words and paths, judged by their runs of letters alone.
PLAIN = re.compile(r"[A-Za-z+/_=-]+|(?:[A-Za-z]+|[0-9]+)(?:[+/_=-]+(?:[A-Za-z]+|[0-9]+))*[+/_=-]*")
LETTERS = re.compile(r"[A-Za-z]+")


@dataclass(frozen=True)
class Params:
    """``ratio``: characters per token below which a candidate counts as random. Candidates, and what base spans
    leave of one, have at least ``least`` characters: shorter strings hold too few tokens to tell."""

    ratio: float = 2.0
    least: int = 20
    vocabulary: str = tokenizer_file("byte_bpe_50k.tiktoken")


def ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file (some 50,000 lines: a vocabulary, not data), read on the driver and sent with the tasks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping per kind, too short ones dropped."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return out


def known(s: str) -> bool:
    """Digests, UUIDs and pure numbers."""
    return bool(NUMBER.fullmatch(s) or UUID.fullmatch(s) or DIGEST.fullmatch(s))


def dense(s: str, encode, ratio: float) -> bool:
    """Whether a token covers less than ``ratio`` characters of ``s``.

    Of letters, and of groups of letters or digits, only the runs of letters count, each in the better of its own
    and lower case: numbers between words and capitals do not make a path random.
    """
    if PLAIN.fullmatch(s):
        runs = LETTERS.findall(s)
        return sum(map(len, runs)) < ratio * sum(min(len(encode(r)), len(encode(r.lower()))) for r in runs)
    return len(s) < ratio * len(encode(s))


def outside(a: int, b: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a..b that no taken span covers."""
    out = []
    for x, _, y in sorted(taken):
        if x < b and a < y:
            if a < x:
                out.append((a, x))
            a = max(a, y)
    return out + [(a, b)] if a < b else out


def random_spans(text: str, taken: list[tuple[int, int, int]], encode, p: Params, pattern: re.Pattern) -> list[tuple[int, int, int]]:
    """Candidates that a token covers less than ``ratio`` characters of.

    Of a candidate that base spans touch, what they leave is judged as one string, and its parts are reported
    beside the base spans.
    """
    out = []
    for m in pattern.finditer(text):
        if known(m[0]):
            continue
        parts = outside(m.start(), m.end(), taken) if taken else [m.span()]
        s = "".join(text[a:b] for a, b in parts)
        if len(s) >= p.least and not known(s) and dense(s, encode, p.ratio):
            out += [(a, 3, b) for a, b in parts]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(df: DataFrame, text: str = "text", params: Params = Params()) -> DataFrame:
    """Add ``secrets``: an array of (kind, start, end), by start, then kind; ends are exclusive code points.

    Also ``base_spans`` and ``spans`` (comma-joined), the counts ``n_assign``, ``n_access``, ``n_hex``,
    ``n_random``, and ``clean_text`` with the spans redacted. A null or empty text has none and stays as
    it is; repeated rows get equal results; an empty table stays empty. Input columns with these names
    are replaced. A row needs no other row: tasks that are lost are run again.
    """
    table = ranks(df.sparkSession, params.vocabulary)
    keep = [c for c in df.columns if c.lower() not in (
        "secrets", "base_spans", "spans", "n_assign", "n_access", "n_hex", "n_random", "clean_text")]
    rows = df.select(*[F.col(f"`{c}`") for c in keep])
    added = ("secrets array<struct<kind:string,start:long,end:long>>, base_spans string, spans string, "
             "n_assign long, n_access long, n_hex long, n_random long, clean_text string")
    extra = StructType.fromDDL(added)
    schema = StructType(rows.schema.fields + extra.fields)
    shared = df.sparkSession.sparkContext.broadcast(table)
    source, pattern = text, re.compile(CANDIDATE % params.least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("ranks", pat_str=CUT, mergeable_ranks=shared.value, special_tokens={})
        for b in batches:
            made: dict[str, list] = {f.name: [] for f in extra.fields}
            for value in b.column(source):
                t = value.as_py()
                base = base_spans(t or "")
                spans = sorted(base + random_spans(t or "", base, encoder.encode_ordinary, params, pattern))
                made["secrets"].append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in spans])
                made["base_spans"].append(joined(base))
                made["spans"].append(joined(spans))
                for i, name in enumerate(KINDS):
                    made[f"n_{name}"].append(sum(k == i for _, k, _ in spans))
                made["clean_text"].append(redact(t, spans) if spans else t)
            kinds = {"secrets": pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))}
            arrays = [pa.array(v, kinds.get(n) or (pa.int64() if n[:2] == "n_" else pa.string())) for n, v in made.items()]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *made])

    return rows.mapInArrow(run, schema)


def digest_columns(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    return scanned.select(F.col(key), "n_assign", "n_access", "n_hex",
                          F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_random")


def without_secrets(df: DataFrame, text: str = "text", params: Params = Params()) -> DataFrame:
    """``df`` with secrets redacted in ``text``; all rows and columns stay."""
    names = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    done = scan(rows, "_text", params)
    return done.select(*[(F.col("clean_text") if c == text else F.col(f"_row.`{c}`")).alias(c) for c in names])


def sha256_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
