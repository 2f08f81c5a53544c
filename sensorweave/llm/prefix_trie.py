"""Prefix trie of conversations by halving the depth: names of blocks first, trees below them, totals last."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorweave.llm.common import discard, stage

ROOT = b"\0" * 16
#: Members of one chunk of an id list: ids that share all but these low bits, so a chunk is bounded.
CHUNK_BITS = 16


@dataclass(frozen=True)
class Params:
    """``leaf`` (a power of two): depth of the smallest trees, which are built inside one row. ``hot``: parents with
    more children than this, or than a 100,000th of all nodes, are joined apart, so at most 100,000 of them."""

    leaf: int = 64
    hot: int = 1_000


def digest(*parts: Column) -> Column:
    """128 bits of the SHA-256 of the parts."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``pos`` (from 0), ``name`` of (role, text) and ``bytes`` of the text, in the order of the turns.

    Null turns come first; rows of one turn are ordered by the name, so equal rows may stand either way. A
    null role or text is empty. Rows without a conversation are left out. A conversation may hold a third of
    all rows: rows are sorted over the whole table and numbered per partition, offsets come from the counts.
    """
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    name = digest(F.octet_length(role_).cast("string").cast("binary"), F.lit(b":"), role_.cast("binary"), text_.cast("binary"))
    rows = df.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                     name.alias("name"), F.octet_length(text_).cast("long").alias("bytes")).where("conv is not null")
    order = ["conv", F.col("turn").asc_nulls_first(), "name", "_any"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = (rows.withColumn("_any", F.monotonically_increasing_id())  # equal rows can be cut anywhere
              .repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    fixed = stage(spread.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop("_any"), "trie-turns")
    counts = fixed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    # few rows each: a conversation has one per partition that it reaches into
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).select("conv", "part", "_first", "_before")
    return fixed.join(starts, ["conv", "part"]).select(
        "conv", (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "name", "bytes")


def shared_starts(turns: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """The rebuilt conversations: the first h turns of conversation c - c % ``group``, then c's own after its first h.

    h is crc32 of the decimal c modulo ``most`` + 1. Conversations that lose all their turns stay as one row
    with a null ``pos``. Only a conversation's length and its first ``most`` turns are joined, so no join
    meets a long conversation as a whole.
    """
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most + 1))
    own = lengths.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % group)
    base = lengths.select(F.col("conv").alias("base"), F.col("length").alias("_base"))
    convs = stage(own.join(base, "base", "left").select(
        "conv", "base", "h", "length", F.least("h", F.coalesce("_base", F.lit(0))).alias("taken")), "trie-convs")
    starts = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    copied = convs.join(starts, "base").where("pos < taken").select("conv", "pos", "name", "bytes")
    # what each conversation's own turns move by, spelled out per block of turns: a long one has many keys
    block = 4096
    moves = (convs.where("length > h").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))))
             .select("conv", "_block", "h", "taken"))
    rest = (turns.withColumn("_block", F.floor(F.col("pos") / block)).join(moves, ["conv", "_block"]).where("pos >= h")
            .select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "bytes"))
    empty = convs.where((F.col("taken") == 0) & (F.col("length") <= F.col("h"))).select(
        "conv", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("name"), F.lit(None).cast("long").alias("bytes"))
    return copied.unionByName(rest).unionByName(empty)


def _chunks(turns: DataFrame, leaf: int) -> DataFrame:
    """Blocks of ``leaf`` positions: ``names`` and ``bytes`` in order, ``ends`` where the sequence stops in the block.

    The place after the last turn counts as a position, so that the last prefix has a block of its own.
    """
    place = F.col("pos").isNotNull()
    here = turns.where(place).select("conv", F.floor(F.col("pos") / leaf).alias("block"), F.struct("pos", "name", "bytes").alias("t"))
    stops = turns.groupBy("conv").agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("n")).select(
        "conv", F.floor(F.col("n") / leaf).alias("block"), F.struct(
            F.col("n").alias("pos"), F.lit(None).cast("binary").alias("name"), F.lit(None).cast("long").alias("bytes")).alias("t"))
    return here.unionByName(stops).groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv", "block", F.transform("t", lambda x: x["name"]).alias("names"), F.transform("t", lambda x: x["bytes"]).alias("bytes"),
        F.get("t", F.size("t") - 1)["name"].isNull().alias("ends"))


def _named_blocks(chunks: DataFrame) -> list[DataFrame]:
    """Names of blocks, level by level: a block of twice the size is named by the names of its halves.

    Each level holds ``conv``, ``block``, ``left`` (name of the left half, null unless whole) and ``has_right``;
    it has at most half the blocks of the level below, and no group has more than two.
    """
    whole = F.when(~F.col("ends"), digest(F.array_join(F.transform("names", lambda x: F.hex(x)), "").cast("binary")))
    now = chunks.select("conv", "block", whole.alias("name"))
    levels = []
    while True:
        odd = F.col("block") % 2 == 1
        up = now.groupBy("conv", F.shiftright("block", 1).alias("block")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("left"), F.max(F.when(odd, F.col("name"))).alias("_right"),
            F.max(odd).alias("has_right"))
        up = stage(up.withColumn("name", digest(F.lit(b"pair"), F.col("left"), F.col("_right"))).drop("_right"), "trie-names")
        levels.append(up)
        if not up.where("block > 0").head(1):
            return levels
        now = up.select("conv", "block", "name")


def _rooted_blocks(levels: list[DataFrame]) -> DataFrame:
    """For each chunk the name of the prefix before it, ``up[0]``, and before the larger blocks around it.

    Top down: the left half of a block hangs where the block does, the right half below the prefix that ends
    with the left half. Equal prefixes get equal names, so trees of different conversations merge by name.
    ``next`` is the prefix before the following chunk.
    """
    root = F.lit(ROOT)
    now = levels[-1].select("conv", "block", "left", "has_right", F.array(root).alias("up"), F.lit(None).cast("binary").alias("next"))
    for depth in range(len(levels) - 1, -1, -1):
        middle = F.when(F.col("has_right"), digest(F.lit(b"tree"), F.get("up", F.lit(0)), F.col("left")))
        child = lambda side, at, nxt: F.struct(
            (2 * F.col("block") + side).alias("block"), F.concat(F.array(at), F.col("up")).alias("up"), nxt.alias("next"))
        halves = F.array(child(0, F.get("up", F.lit(0)), F.coalesce(F.col("_m"), F.col("next"))),
                         child(1, F.col("_m"), F.col("next")))
        both = now.withColumn("_m", middle).select("conv", F.explode(F.when(F.col("has_right"), halves).otherwise(
            F.slice(halves, 1, 1))).alias("x")).select("conv", "x.block", "x.up", "x.next")
        if depth == 0:
            return stage(both, "trie-roots")
        now = stage(both.join(levels[depth - 1].drop("name"), ["conv", "block"]), "trie-roots")


def _prefixes(chunks: DataFrame, roots: DataFrame) -> DataFrame:
    """Chunks with ``ids``, the names of the prefixes that end at their positions, and that of the next chunk's first."""
    both = chunks.join(roots, ["conv", "block"])
    grow = F.aggregate(F.slice("names", 1, F.size("names") - 1), F.array(F.get("up", F.lit(0))), lambda ids, name: F.concat(
        ids, F.array(digest(F.lit(b"turn"), F.get(ids, F.size(ids) - 1), name))))
    more = F.when(F.col("ends"), F.lit([]).cast("array<binary>")).otherwise(F.array("next"))
    return both.select("conv", "block", "bytes", "ends", "up", F.concat(grow, more).alias("ids"))


def _occurrences(prefixes: DataFrame, leaf: int) -> DataFrame:
    """One row per conversation and non-empty prefix: ``node``, ``parent``, ``depth``, ``bytes`` and ``up``.

    ``up[j]`` names the prefix at which the tree of 2^j levels around the node hangs, where that is the lower
    half of the next larger tree; null otherwise.
    """
    rows = prefixes.where(F.size("ids") > 1).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    at = lambda k: F.get("ids", k)
    inside = [F.when(F.shiftright(F.col("i") - 1, j) % 2 == 1, at(F.shiftleft(F.shiftright(F.col("i") - 1, j), j)))
              for j in range(leaf.bit_length() - 1)]
    above = F.transform("up", lambda u, j: F.when(F.floor(F.col("block") / F.pow(F.lit(2.0), j)) % 2 == 1, u))
    return rows.select("conv", at(F.col("i")).alias("node"), at(F.col("i") - 1).alias("parent"),
                       (F.col("block") * leaf + F.col("i")).alias("depth"), F.get("bytes", F.col("i") - 1).alias("bytes"),
                       F.concat(F.array(*inside), above).alias("up"))


def _graft(nodes: DataFrame, levels: int) -> DataFrame:
    """Sums of ``saved`` and ``leaf`` over all nodes strictly below each node: ``node``, ``below_saved``, ``below_leaf``.

    The tallest trees first: each tree of 2^(j-1) levels that is a lower half sums its own nodes onto the node
    that it hangs at. Nodes of its deepest level have lower trees of their own, grafted in an earlier round, and
    bring these sums along. A node is a hanging point in one round alone, by the lowest set bit of its depth.
    """
    done: DataFrame | None = None
    for j in range(levels, 0, -1):
        key = F.get("up", F.lit(j - 1))
        own = nodes.where(key.isNotNull()).select(key.alias("node"), F.col("saved").alias("s"), F.col("leaf").alias("l"))
        if done is not None:
            deepest = nodes.where(key.isNotNull() & (F.col("depth") % (1 << j) == 0)).select("node", key.alias("_to"))
            own = own.unionByName(deepest.join(done, "node").select(
                F.col("_to").alias("node"), F.col("below_saved").alias("s"), F.col("below_leaf").alias("l")))
        sums = own.groupBy("node").agg(F.sum("s").alias("below_saved"), F.sum("l").alias("below_leaf"))
        new = stage(sums, "trie-below")
        done = new if done is None else done.unionByName(new)
    return done


def _ends_sha256(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of each ``node``.

    Ids are joined in chunks of neighbouring ids, bounded whatever the group; one task then hashes the
    chunks of a node in order, as the digest demands, holding one chunk at a time.
    """
    chunks = ends.groupBy("node", F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            names, sums = [], []
            for key, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
                if key != node:
                    if state is not None:
                        names.append(node)
                        sums.append(state.hexdigest())
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sums, pa.string())], names=["node", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "sha256": [state.hexdigest()]})

    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(
        run, "node binary, sha256 string")


def trie(turns: DataFrame, p: Params = Params()) -> DataFrame:
    """Every distinct prefix of the sequences in ``turns`` (``conv``, ``pos`` from 0 without gaps, ``name``, ``bytes``).

    A row with a null ``pos`` stands for a sequence without turns. Returns ``node`` (a 128-bit name), ``conv_id``
    (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    and ``ends_sha256``. No sequences: no rows. Rounds grow with the logarithm of the longest sequence; no step
    handles a sequence, a node's members or a node's children as one group.
    """
    turns = stage(turns, "trie-sequences")
    chunks = stage(_chunks(turns, p.leaf), "trie-chunks")
    if not chunks.head(1):
        return turns.sparkSession.createDataFrame([], _SCHEMA)
    levels = _named_blocks(chunks)
    roots = _rooted_blocks(levels)
    prefixes = stage(_prefixes(chunks, roots), "trie-prefixes")
    rows = _occurrences(prefixes, p.leaf)
    count = F.count(F.lit(1))
    # equal within a node: parent, depth, bytes and up
    members = stage(rows.groupBy("node").agg(
        F.min("conv").alias("conv_id"), count.alias("n_convs"), F.first("parent").alias("parent"), F.first("depth").alias("depth"),
        F.first("bytes").alias("bytes"), F.first("up").alias("up")), "trie-members")
    children = members.groupBy(F.col("parent").alias("node")).agg(count.alias("n_children"))
    ends = prefixes.where("ends").select(F.get("ids", F.size("ids") - 1).alias("node"), "conv")  # one each
    top = chunks.where("block = 0").agg(F.min("conv").alias("conv_id"), count.alias("n_convs")).select(  # one each
        F.lit(ROOT).alias("node"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("array<binary>").alias("up"))
    nodes = (members.unionByName(top).join(children, "node", "left").join(_ends_sha256(ends), "node", "left")
             .withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
             .withColumn("leaf", (F.col("n_children") == 0).cast("long")).drop("bytes"))
    nodes = stage(nodes, "trie-nodes")
    facts = nodes.agg(F.max("depth"), F.sum("saved"), F.sum("leaf"), count).first()
    deepest, saved, leaves, n = facts
    below = _graft(nodes.where("depth > 0"), max(int(deepest).bit_length(), 1))
    summed = nodes.join(below, "node", "left").withColumns({
        "saved_tokens": F.when(F.col("depth") == 0, F.lit(saved)).otherwise(F.col("saved") + F.coalesce("below_saved", F.lit(0))),
        "n_leaves": F.when(F.col("depth") == 0, F.lit(leaves)).otherwise(F.col("leaf") + F.coalesce("below_leaf", F.lit(0)))})
    # a parent may have most nodes as children: such parents are few and go to all tasks
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("_of"), "n_children").where("n_children > 0")
    hot = max(p.hot, n // 100_000)
    many = F.broadcast(parents.where(F.col("n_children") > hot).select("parent", F.col("_of").alias("_hot")))
    few = parents.where(F.col("n_children") <= hot).select("parent", F.col("_of").alias("_few"))
    marked = stage(summed.join(many, "parent", "left"), "trie-summed")
    columns = lambda parent: ["node", "conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"),
                              "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
                              F.col("saved_tokens").cast("long").alias("saved_tokens"),
                              F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")]
    out = marked.where("_hot is null").join(few, "parent", "left").select(*columns(F.col("_few"))).unionByName(
        marked.where("_hot is not null").select(*columns(F.col("_hot"))))
    for used in (chunks, roots, prefixes, members, turns, *levels):
        discard(used)
    return out


_SCHEMA = ("node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, ends_sha256 string")


def conversation_trie(df: DataFrame, p: Params = Params(), **columns: str) -> DataFrame:
    """``trie`` of the rebuilt conversations of a table of turns (``ordered_turns``, ``shared_starts``)."""
    turns = stage(ordered_turns(df, **columns), "trie-ordered")
    out = trie(shared_starts(turns), p)
    discard(turns)
    return out
