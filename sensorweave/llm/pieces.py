"""Sampled SentencePiece segmentations without replacement, and decoding.

A text is a chain of units (a run of spaces with the letters after it, or a line end); no piece crosses a
unit's border, so the lattice of the text is the chain of its units' lattices. Backward sums make every
arc's probability exact, and a node's bound in the search is exact as well: the perturbed score of a set of
segmentations is Gumbel noise at the log of the set's total probability. The search therefore expands one
path per sample: it takes the open set with the largest perturbed score, follows its best member through
all units, and files what it left out at each unit as a new open set, below the score it came from. The
scores fall from sample to sample and no segmentation comes twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from xxhash import xxh64_intdigest

from sensorweave.llm.common import tokenizer_file

SPACE = "▁"
UNIT = re.compile(r"\n| *[^ \n]+| +")
#: Characters of the texts whose lattices are built and sampled together.
BATCH_CHARS = 2_000_000


@dataclass(frozen=True)
class Params:
    """``k`` segmentations per row. ``sharpness`` multiplies log-probabilities: 0 is uniform, large is greedy."""

    model: str = tokenizer_file("piece_bpe_32k.model")
    k: int = 2
    sharpness: float = 1.0
    seed: int = 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _next_hash(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings one character longer."""
    return _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(1))


_TOP_BITS = 17
_TOP = np.uint64(64 - _TOP_BITS)


def _find(keys: np.ndarray, below: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``hashes`` of those that are in ``keys``, in order, and their places in ``keys``."""
    top = (hashes >> _TOP).astype(np.int64)
    spot, end = below[top], below[top + 1]
    at = np.flatnonzero(spot < end)
    spot, end, wanted = spot[at], end[at], hashes[at]
    hit = keys[spot] == wanted
    open_ = np.flatnonzero(~hit & (spot + 1 < end))
    while len(open_):
        spot[open_] += 1
        hit[open_] = keys[spot[open_]] == wanted[open_]
        open_ = open_[~hit[open_] & (spot[open_] + 1 < end[open_])]
    return at[hit], spot[hit]


class Vocabulary:
    """Pieces as numbers: hashes of their characters, log-probabilities, and bytes for the rest.

    A model that holds probabilities (unigram) is used as it is. One that holds merge ranks (scores 0, -1,
    -2, ...) gets Zipf's law: a piece's probability falls with one over its rank. A character that is no
    piece is spelled in byte pieces, each as likely as the rarest piece; without them it is the unknown id.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)])
        byte = np.array([sp.is_byte(i) for i in range(n)])
        plain = ~special & ~byte
        ranked = scores[plain & (scores > -1e8)]
        if np.array_equal(ranked, np.round(ranked)):
            rank = np.maximum(-scores, 0) + 2
            rank[scores < -1e8] = 2  # runs of spaces: given, not merged
            weight = 1 / rank
            self.logp = np.log(weight / weight[plain].sum())
        else:
            self.logp = scores.copy()
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i in np.flatnonzero(byte):
            self.byte_ids[int(self.text[i][3:-1], 16)] = i
        self.rarest = self.logp[plain].min()
        self.pieces = {self.text[i]: int(i) for i in np.flatnonzero(plain)}
        for p in self.pieces:
            inner = p.lstrip(SPACE)
            if SPACE in inner or "\n" in p:
                raise ValueError(f"piece {p!r} crosses a word border")
        self.prefixes = self._prefixes()
        self.out = [b"" if special[i] else bytes([int(t[3:-1], 16)]) if byte[i] else t.replace(SPACE, " ").encode()
                    for i, t in enumerate(self.text)]

    def _prefixes(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per length: sorted hashes of what pieces begin with, the piece each is by itself (or -1), and for
        each value of a hash's first ``_TOP_BITS`` bits how many of the hashes lie below it."""
        texts, ids = list(self.pieces), np.fromiter(self.pieces.values(), np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(sizes) - sizes
        hashes, live, out = np.zeros(len(texts), np.uint64), np.arange(len(texts)), []
        for size in range(int(sizes.max())):
            live = live[sizes[live] > size]
            hashes[live] = _next_hash(hashes[live], codes[start[live] + size])
            keys = np.unique(hashes[live])
            own = np.full(len(keys), -1, np.int64)
            whole = live[sizes[live] == size + 1]
            own[np.searchsorted(keys, hashes[whole])] = ids[whole]
            tops = np.bincount((keys >> _TOP).astype(np.int64), minlength=1 << _TOP_BITS)
            out.append((keys, own, np.concatenate([[0], np.cumsum(tops)]).astype(np.int32)))
        return out

    def decode(self, ids) -> str:
        """Text of a segmentation: pieces joined, the leading space that encoding adds taken off."""
        text = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    """The vocabulary of a model file, read once per Python worker."""
    return Vocabulary(path)


class Lattices:
    """Lattices of different units, flat: states are positions in units, arcs are pieces."""

    def __init__(self, vocabulary: Vocabulary, units: list[str], sharpness: float):
        v = vocabulary
        sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1
        chars = "".join(u + "\n" for u in units).replace(" ", SPACE)
        codes = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.uint64)
        after = np.cumsum(sizes)
        self.begin = after - sizes
        last = np.repeat(after - 1, sizes)  # the final state of each state's unit
        at = np.flatnonzero(np.arange(len(codes)) < last)
        known = np.zeros(len(codes), bool)
        known[after - 1] = True
        hashes = np.zeros(len(at), np.uint64)
        state, end, piece = [], [], []
        for size, (prefixes, ids, below) in enumerate(v.prefixes, 1):
            inside = at + size <= last[at]
            at, hashes = at[inside], hashes[inside]
            hashes = _next_hash(hashes, codes[at + size - 1])
            found, spot = _find(prefixes, below, hashes)
            at, hashes, own = at[found], hashes[found], ids[spot]
            whole = own >= 0
            state.append(at[whole])
            end.append(at[whole] + size)
            piece.append(own[whole])
            if size == 1:
                known[at[whole]] = True
        odd = np.flatnonzero(~known)
        self.spelled = [chars[i].encode() for i in odd.tolist()]
        state.append(odd)
        end.append(odd + 1)
        length = np.array([len(x) for x in self.spelled], np.int64)
        single = np.array([v.byte_ids[x[0]] for x in self.spelled], np.int64)
        piece.append(np.where(length == 1, single, -1 - np.arange(len(odd))))  # below zero: a spelled character
        rare = v.rarest * length
        # longest pieces first: mostly the likeliest of a state, which the draw looks at first
        odd_piece, odd_state, odd_end = piece.pop(), state.pop(), end.pop()
        piece = np.concatenate([*piece[::-1], odd_piece])
        state, end = np.concatenate([*state[::-1], odd_state]), np.concatenate([*end[::-1], odd_end])
        logp = np.where(piece >= 0, v.logp[np.maximum(piece, 0)], 0.0)
        logp[len(piece) - len(odd):] = rare
        self._normalise(len(codes), state, end, piece, logp * sharpness, last)

    def _normalise(self, n: int, state, end, piece, logp, last) -> None:
        """Arc probabilities given the state, from backward sums, with running sums per state."""
        order = np.argsort(state, kind="stable")
        state, end, piece, logp = state[order], end[order], piece[order], logp[order]
        width = np.bincount(state, minlength=n)
        first = np.concatenate([[0], np.cumsum(width)])
        back = np.zeros(n)
        # states by their distance to the end of the unit, nearest first: all arcs go nearer
        left = last - np.arange(n)
        near = np.argsort(left.astype(np.int16) if left.max(initial=0) < 1 << 15 else left, kind="stable")
        sizes = np.bincount(left)
        at = sizes[0] if len(sizes) else 0
        for size in sizes[1:].tolist():
            s = near[at:at + size]
            at += size
            w = width[s]
            cut = np.cumsum(w) - w
            arcs = np.repeat(first[s] - cut, w)
            arcs += np.arange(len(arcs))
            value = logp[arcs]
            value += back[end[arcs]]
            top = np.maximum.reduceat(value, cut)
            value -= np.repeat(top, w)
            back[s] = top + np.log(np.add.reduceat(np.exp(value, out=value), cut))
        self.end, self.piece, self.first = end.astype(np.int32), piece.astype(np.int32), first
        self.logp = logp + back[end] - back[state]
        share = np.exp(self.logp)
        total = np.cumsum(share)
        self.upto = (total - np.concatenate([[0.0], total])[first[state]]).astype(np.float32)
        self.upto[first[1:][width > 0] - 1] = 2.0  # rounding never passes the last arc

    def draw(self, units: np.ndarray, noise) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each unit a segmentation: all arcs in the sequence of the units, arcs per unit, and the
        log-probability per unit. ``noise(places, step)`` gives numbers in (0, 1)."""
        total = np.zeros(len(units))
        sizes = np.zeros(len(units), np.int64)
        where = np.arange(len(units))
        state = self.begin[units]
        drawn = []
        while len(where):
            u = noise(where, len(drawn))
            arc = self.first[state]
            over = np.flatnonzero(u >= self.upto[arc])
            while len(over):
                arc[over] += 1
                over = over[u[over] >= self.upto[arc[over]]]
            total[where] += self.logp[arc]
            drawn.append((where, arc))
            sizes[where] = len(drawn)
            state = self.end[arc]
            more = np.flatnonzero(self.first[state + 1] > self.first[state])
            where, state = where[more], state[more]
        start = np.cumsum(sizes) - sizes
        arcs = np.empty(int(sizes.sum()), np.int64)
        for step, (where, arc) in enumerate(drawn):
            arcs[start[where] + step] = arc
        return arcs, sizes, total

    def ids(self, arcs: np.ndarray, byte_ids: np.ndarray) -> np.ndarray:
        """Piece ids of arcs, spelled characters as their bytes."""
        p = self.piece[arcs]
        odd = np.flatnonzero(p < 0)
        if not len(odd):
            return p.astype(np.int32)
        raw = [byte_ids[np.frombuffer(self.spelled[-k - 1], np.uint8)] for k in p[odd].tolist()]
        size = np.ones(len(p), np.int64)
        size[odd] = [len(x) for x in raw]
        out = np.repeat(p, size).astype(np.int32)
        start = (np.cumsum(size) - size)[odd]
        spots = np.concatenate([np.arange(a, a + len(x)) for a, x in zip(start.tolist(), raw)])
        out[spots] = np.concatenate(raw)
        return out


def uniform(seeds: np.ndarray, a: np.ndarray | int, b: int) -> np.ndarray:
    """Numbers in (0, 1) fixed by a row's seed and two counters, whatever else is in the batch."""
    step = np.full(1, b * 0xD6E8FEB86659FD93 & (1 << 64) - 1, np.uint64)
    key = np.atleast_1d(a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + step
    x = _mix(seeds + key) >> np.uint64(11)
    return (x.astype(np.float64) + 0.5) / (1 << 53)


def _below(location, bound, u):
    """Gumbel noise at ``location`` given that it is below ``bound``."""
    return location - np.logaddexp(location - bound, np.log(-np.log(u)))


class _Row:
    """Search state of one text: its units, its samples, and the open sets it may branch from."""

    __slots__ = ("units", "seed", "samples", "open", "draws", "done")

    def __init__(self, units: np.ndarray, seed: int):
        self.units, self.seed = units, seed
        self.samples: list[dict] = []
        self.open: list[dict] = []
        self.draws = 0
        self.done = False


def _extend(row: _Row, base: dict | None, at: int, head: float, score: float, arcs, sizes, logps, salt: int) -> None:
    """Add the sample that follows ``base`` up to unit ``at`` and the drawn units from there, and file what
    was left out at each drawn unit as one open set per path (largest first found by ``_best``)."""
    n = len(logps)
    run = head + np.concatenate([[0.0], np.cumsum(logps)])
    rest = np.full(n, -np.inf)
    free = np.flatnonzero(logps < -1e-12)
    rest[free] = run[free] + np.log(-np.expm1(logps[free]))
    u = uniform(np.full(1, row.seed, np.uint64), np.arange(at, at + n), salt)
    left = np.full(n, -np.inf)
    left[free] = _below(rest[free], score, u[free])
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    sample = {"base": base, "at": at, "arcs": arcs, "cuts": cuts, "run": run, "score": score, "logp": float(run[-1]),
              "left": left, "taken": {}}
    row.samples.append(sample)


def _best(row: _Row) -> tuple[dict, int, float] | None:
    """The open set with the largest perturbed score: its path, the unit it branches at, the score."""
    top = None
    for s in row.samples:
        if len(s["left"]):
            i = int(np.argmax(s["left"]))
            if s["left"][i] > -np.inf and (top is None or s["left"][i] > top[2]):
                top = (s, i, float(s["left"][i]))
    return top


def _unit_arcs(s: dict, i: int) -> tuple:
    return tuple(s["arcs"][s["cuts"][i]:s["cuts"][i + 1]].tolist())


def _path(s: dict, upto: int | None = None) -> list[np.ndarray]:
    """Arc arrays of a sample's units before ``upto`` (all if none), in order."""
    parts = _path(s["base"], s["at"]) if s["base"] is not None else []
    end = len(s["cuts"]) - 1 if upto is None else upto - s["at"]
    if end < 0:
        return _path(s["base"], upto)
    return [*parts, s["arcs"][:s["cuts"][end]]]


def _chance(seed: int, a: int, b: int) -> float:
    """``uniform`` for one number."""
    mask = (1 << 64) - 1
    x = (seed + a * 0x9E3779B97F4A7C15 + b * 0xD6E8FEB86659FD93) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return (((x ^ (x >> 31)) >> 11) + 0.5) / (1 << 53)


def _branch_unit(lattices: Lattices, unit: int, banned: set, seed: int, salt: int) -> tuple[np.ndarray, float]:
    """A segmentation of one unit other than the banned ones: drawn until one is new."""
    first, upto = lattices.first, lattices.upto
    for tries in range(64):
        state, path = int(lattices.begin[unit]), []
        while (arc := int(first[state])) < first[state + 1]:
            u = _chance(seed, tries, salt + 7919 * len(path))
            while u >= upto[arc]:
                arc += 1
            path.append(arc)
            state = int(lattices.end[arc])
        if tuple(path) not in banned:
            return np.array(path, np.int64), float(lattices.logp[path].sum())
    return _rest_unit(lattices, unit, banned, _chance(seed, 0, salt))


def _rest_unit(lattices: Lattices, unit: int, banned: set, u: float) -> tuple[np.ndarray, float]:
    """The same by walking the lattice less the banned paths: for units where these hold nearly all mass."""
    state, path, total = int(lattices.begin[unit]), [], 0.0
    while lattices.first[state + 1] > lattices.first[state]:
        arcs = np.arange(lattices.first[state], lattices.first[state + 1])
        share = np.exp(lattices.logp[arcs])
        for b in banned:
            if b[:len(path)] == tuple(path) and len(b) > len(path):
                tail = np.exp(sum(float(lattices.logp[a]) for a in b[len(path):]))
                share[b[len(path)] - arcs[0]] -= tail
        share = np.maximum(share, 0)
        total_share = share.sum()
        pick = int(np.searchsorted(np.cumsum(share), u * total_share, side="right"))
        pick = min(pick, len(arcs) - 1)
        while share[pick] <= 0 and pick:
            pick -= 1
        u = _chance(int(u * (1 << 53)), len(path), 3)
        path.append(int(arcs[pick]))
        total += float(lattices.logp[arcs[pick]])
        state = int(lattices.end[arcs[pick]])
    return np.array(path, np.int64), total


def sample(vocabulary: Vocabulary, texts: list[str], seeds: list[int], k: int, sharpness: float = 1.0) -> list[list[dict]]:
    """Up to ``k`` segmentations per text, best perturbed score first.

    Each has ``ids``, ``logp``, ``score`` and ``inclusion``: the probability that a segmentation of this
    probability is among the first ``k``, given the next score below (1 where no further one exists).
    """
    split = [UNIT.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
    distinct = list(dict.fromkeys(chain.from_iterable(split)))
    number = dict(zip(distinct, range(len(distinct))))
    coded = [np.fromiter(map(number.__getitem__, units), np.int64, len(units)) for units in split]
    lattices = Lattices(vocabulary, distinct, sharpness)
    del split, number, distinct
    rows = [_Row(c, s) for c, s in zip(coded, seeds)]
    everything = lambda jobs, salt: _draw_all(lattices, jobs, salt)

    jobs = []
    for r in rows:
        if len(r.units):
            u = _chance(r.seed, 0, 1)
            jobs.append((r, None, 0, 0.0, -np.log(-np.log(u)), None))
        else:
            r.samples.append({"base": None, "at": 0, "arcs": np.zeros(0, np.int64), "cuts": np.zeros(1, np.int64),
                              "run": np.zeros(1), "score": 0.0, "logp": 0.0, "left": np.zeros(0), "taken": {}})
            r.done = True
    everything(jobs, 10)
    for round_ in range(1, k):
        jobs = []
        for r in rows:
            top = None if r.done else _best(r)
            if top is None:
                r.done = True
                continue
            s, i, score = top
            at = s["at"] + i
            banned = s["taken"].setdefault(i, {_unit_arcs(s, i)})
            arc, logp = _branch_unit(lattices, int(r.units[at]), banned, r.seed, 1000 * round_ + 13)
            banned.add(tuple(arc.tolist()))
            # what is still left out at this unit, below the score just taken
            mass = sum(np.exp(sum(float(lattices.logp[a]) for a in b)) for b in banned)
            rest = s["run"][i] + np.log1p(-mass) if mass < 1 - 1e-9 else -np.inf
            u = _chance(r.seed, at, 1000 * round_ + 17)
            s["left"][i] = _below(rest, score, u) if rest > -np.inf else -np.inf
            jobs.append((r, s, at, float(s["run"][i]), score, (arc, logp)))
        everything(jobs, 10 + 1000 * round_)
    out = []
    for r in rows:
        after = None if r.done else _best(r)
        made = []
        for s in r.samples:
            arcs = np.concatenate(_path(s))
            share = 1.0 if after is None else float(-np.expm1(-np.exp(s["logp"] - after[2])))
            made.append({"ids": lattices.ids(arcs, vocabulary.byte_ids), "logp": s["logp"], "score": float(s["score"]),
                         "inclusion": share})
        out.append(made)
    return out


def _draw_all(lattices: Lattices, jobs: list[tuple], salt: int) -> None:
    """Draw the open units of all jobs at once and add a sample to each job's row."""
    if not jobs:
        return
    parts = [r.units[at + (first is not None):] for r, _, at, _, _, first in jobs]
    units = np.concatenate(parts)
    seeds = np.repeat(np.array([j[0].seed for j in jobs], np.uint64), [len(p) for p in parts])
    spot = np.concatenate([np.arange(j[2] + (j[5] is not None), j[2] + (j[5] is not None) + len(p)) for j, p in zip(jobs, parts)])
    start = _mix(seeds + spot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.full(1, salt, np.uint64))

    def noise(places, step):
        x = start[places] * np.uint64(2 * step + 0x5851F42D4C957F2D)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)

    arcs, sizes, logp = lattices.draw(units, noise)
    unit_cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    arc_cuts = np.concatenate([[0], np.cumsum(sizes)])
    for j, (r, base, at, head, score, first) in enumerate(jobs):
        a, b = unit_cuts[j], unit_cuts[j + 1]
        own, size, lp = arcs[arc_cuts[a]:arc_cuts[b]], sizes[a:b], logp[a:b]
        if first is not None:
            own, size, lp = np.concatenate([first[0], own]), np.concatenate([[len(first[0])], size]), np.concatenate([[first[1]], lp])
        _extend(r, base, at, head, score, own, size, lp, salt + 3)
        if first is not None:  # the branch unit's own rest is filed with the path it left
            r.samples[-1]["left"][0] = -np.inf


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", p: Params = Params()) -> DataFrame:
    """``key``, ``sample`` (from 0), ``ids``, ``n_pieces``, ``logp``, ``score``, ``inclusion``: up to ``k`` rows a text.

    Segmentations of a text differ, and all decode to it (U+2581 becomes a space, as in the model). A text
    with fewer than ``k`` segmentations gives them all; a null or empty text gives one of no pieces. The
    samples hang on the text's key and ``seed`` alone, so a task that is run again gives the same; rows
    that repeat a key and text repeat the samples. Needs no shuffle.
    """
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"),
                     F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_name"))
    tail = StructType.fromDDL("sample int, ids array<int>, n_pieces int, logp double, score double, inclusion double")
    schema = StructType([StructField(key, rows.schema["_key"].dataType, True), *tail.fields])

    def flush(vocabulary, held) -> Iterator[pa.RecordBatch]:
        texts = [t for _, t, _ in held]
        made = sample(vocabulary, texts, [xxh64_intdigest(n, p.seed) for _, _, n in held], p.k, p.sharpness)
        keys, cols = [], {f.name: [] for f in tail.fields}
        for (one, _, _), segmentations in zip(held, made):
            for i, s in enumerate(segmentations):
                keys.append(one)
                for name, value in (("sample", i), ("ids", s["ids"]), ("n_pieces", len(s["ids"])), ("logp", s["logp"]),
                                    ("score", s["score"]), ("inclusion", s["inclusion"])):
                    cols[name].append(value)
        cuts = np.concatenate([[0], np.cumsum(cols["n_pieces"])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(cols["ids"]) if keys else [], pa.int32()))
        kinds = {"sample": pa.int32(), "n_pieces": pa.int32()}
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), *[lists if n == "ids" else pa.array(v, kinds.get(n, pa.float64())) for n, v in cols.items()]],
            names=[key, *cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, size = vocabulary_of(p.model), [], 0
        for b in batches:
            for one, t, name in zip(b.column("_key"), b.column("_text"), b.column("_name")):
                t = t.as_py() or ""
                held.append((one, t, name.as_py()))
                size += len(t)
                if size >= BATCH_CHARS:
                    yield from flush(vocabulary, held)
                    held, size = [], 0
        if held:
            yield from flush(vocabulary, held)

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", model: str = Params.model) -> DataFrame:
    """Add the text of the piece ids in ``ids``; null ids give a null text, no ids the empty text."""
    names = [c for c in df.columns if c != out]
    rows = df.select(*[F.col(f"`{c}`") for c in names])
    schema = StructType(rows.schema.fields + StructType.fromDDL(f"`{out}` string").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model)
        for b in batches:
            texts = [None if x.as_py() is None else vocabulary.decode(x.as_py()) for x in b.column(ids)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, out])

    return rows.mapInArrow(run, schema)
