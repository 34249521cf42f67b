"""The trie of conversation prefixes: who shares which first turns, and what sharing saves.

Conversations are rebuilt first: each takes its first turns from the conversation at the head
of its five. Every distinct sequence of first d rebuilt turns is a node. Then

1. the digest of each prefix is a chain over digests of turns; chains run over blocks of
   BLOCK turns, and a block's start is chained to the blocks before it, so a conversation
   with any share of all turns is divided over tasks;
2. an aggregation by digest, combined before it is shuffled, enumerates the nodes with
   members and smallest member;
3. nodes are dealt over shards by the piece of the trie that they are in. A node with more
   than LIMIT turns of members below it is on top; a piece is what hangs below the top. So
   a first turn that a third of all conversations share is no piece, but its continuations are;
4. a shard enumerates its digests by a minimal perfect hash: each has a slot, at which the
   digest itself is kept, so that a lookup of another one is told apart. Counts are scattered
   into flat arrays by slot, and are added up through the array of parents' slots, one depth
   after the other from the deepest;
5. the few nodes on top get the sums of the pieces below them and add up among themselves
   by doubling: after r rounds a node has the sums of all less than 2^r below it.

Turns are ordered by turn, null first; of equal turns the one with the lesser digest comes
first, equal rows stay two turns. Null roles and texts are empty. Rows without conv_id are
left out. A conversation without turns is a member of the root. An empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailhead.llm import base
from trailhead.llm.shingles import mix

#: Heads of five give at most HEADS - 1 turns.
FIVE, HEADS = 5, 9
BLOCK, LIMIT, SHARD = 4096, 1 << 16, 1 << 16
#: Ids of a range this wide are written as one text before they are put in a row.
IDS = 4096
ROOT = bytes(16)
_PREFIX = "conv_id long, depth long, digest binary, parent binary, size long, length long"
_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class Slots:
    """A minimal perfect hash of distinct 128-bit keys, a row of two numbers each.

    At each level the keys that are alone at their place have it; the others go on to the
    next level. A slot is the number of such places before, over all levels.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        left, given = np.arange(len(keys)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("keys are not distinct")
            seed = np.uint64(len(self.levels) + 1)
            at = self._place(keys[left], seed, 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            self.levels.append((seed, alone, given - 1 + np.cumsum(alone)))
            given += int(alone.sum())
            left = left[~alone[at]]
        self.keys = np.empty_like(keys)
        self.keys[self._slots(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, seed: np.uint64, size: int) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1] + seed)) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for seed, alone, rank in self.levels:
            at = self._place(keys[left], seed, len(alone))
            found = alone[at]
            out[left[found]] = rank[at[found]]
            left = left[~found]
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the key isn't one of these."""
        out = self._slots(keys)
        has = out >= 0
        has[has] = (self.keys[out[has]] == keys[has]).all(1)
        return np.where(has, out, -1)


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, the digest t of role and text, and size, the bytes of the text.

    Turns are sorted in ranges, which may divide a conversation; the turns of it in earlier
    ranges are counted by range, and no more conversations than ranges are divided.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), t.alias("t"), F.octet_length(text).cast("long").alias("size"))
    rows = base.materialise(rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "t").withColumn("part", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "t")
    held = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    divided = held.select("conv_id", "part", before.alias("before")).where("before > 0")
    return rows.withColumn("pos", F.row_number().over(inside)).join(F.broadcast(divided), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "t", "size")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv_id, depth, t, size, length), and every conversation with its length."""
    turns = base.materialise(_turns(conversations), "turns")
    held = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h, head = F.crc32(F.col("conv_id").cast("string")) % HEADS, F.col("conv_id") - F.col("conv_id") % FIVE
    heads = held.select(F.col("conv_id").alias("head"), F.col("n").alias("n_head"))
    taken = F.least("h", F.coalesce("n_head", F.lit(0)))
    convs = held.withColumn("h", h).withColumn("head", head).join(heads, "head", "left").withColumn("k", taken)
    convs = base.materialise(convs.select("conv_id", "n", "head", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    first = turns.where((F.col("conv_id") % FIVE == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "head")
    from_head = convs.drop("n").join(first, "head").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "t", "size", "length")
    total = convs.agg(F.sum("n")).first()[0] or 0
    own = base.spread_join(turns, convs.select("conv_id", "n", "h", "k", "length"), "conv_id", "pos", total).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "t", "size", "length")
    return from_head.unionByName(own), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, digest of the first depth turns, and the parent's; size and length as in turns."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("size", pa.int64()), ("length", pa.int64())])
    number = F.floor((F.col("depth") - 1) / block).alias("block")

    def chain(batches):
        at, last = None, ROOT
        for batch in batches:
            digests, parents = [], []
            for conv, part, t in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "t")), strict=True):
                if (conv, part) != at:
                    at, last = (conv, part), ROOT
                parents.append(last)
                last = hashlib.md5(last + t, usedforsecurity=False).digest()
                digests.append(last)
            yield base.batch_of({"conv_id": batch.column("conv_id"), "depth": batch.column("depth"), "digest": digests, "parent": parents, "size": batch.column("size"), "length": batch.column("length")}, schema)

    rows = turns.withColumn("block", number).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    made = base.materialise(base.arrow_map(rows.select("conv_id", "block", "depth", "t", "size", "length"), chain, _PREFIX), "prefixes")
    later = made.where(F.col("depth") > block).withColumn("block", number)
    if later.isEmpty():
        return made
    start_schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("start", pa.binary())])

    def starts(table):
        """Where each later block starts: the digest of all turns before it."""
        table, last, out = table.sort_by("block"), None, []
        for digest in table.column("digest").to_pylist():
            last = digest if last is None else hashlib.md5(last + digest, usedforsecurity=False).digest()
            out.append(last)
        return pa.table({"conv_id": table.column("conv_id"), "block": table.column("block"), "start": pa.array(out, pa.binary())}, schema=start_schema)

    ends = made.where((F.col("depth") % block == 0) & (F.col("depth") < F.col("length"))).select("conv_id", (F.col("depth") / block).cast("long").alias("block"), "digest")
    found = ends.groupBy("conv_id").applyInArrow(starts, "conv_id long, block long, start binary")
    joined = later.join(found, ["conv_id", "block"])
    after = lambda c: F.unhex(F.md5(F.concat("start", c)))
    parent = F.when(F.col("depth") % block == 1 % block, F.col("start")).otherwise(after("parent"))
    later = joined.select("conv_id", "depth", after("digest").alias("digest"), parent.alias("parent"), "size", "length")
    return base.materialise(made.where(F.col("depth") <= block).unionByName(later), "prefixes")


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _summed(table: pa.Table) -> pa.Table:
    """A shard's nodes with children, and sums over their subtrees, by slots."""
    keys = _keys(table.column("digest"))
    slots = Slots(keys)
    slot = slots.of(keys)
    up_of = slots.of(_keys(table.column("parent")))
    n = len(keys)
    conv, depth, up, saved = (np.empty(n, np.int64) for _ in range(4))
    convs, size, names = (table.column(c).to_numpy() for c in ("n_convs", "size", "conv_id"))
    conv[slot], depth[slot], up[slot], saved[slot] = names, table.column("depth").to_numpy(), up_of, (convs - 1) * size
    children = np.bincount(up[up >= 0], minlength=n)
    leaves = (children == 0).astype(np.int64)
    inner = np.flatnonzero(up >= 0)
    order = inner[np.argsort(-depth[inner], kind="stable")]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):  # the deepest first
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    above = np.where(up >= 0, conv[up], 0)[slot]
    outer = table.column("up_conv")
    named = pa.array(above, mask=up_of < 0)
    return pa.table(
        {
            "digest": table.column("digest"), "parent": table.column("parent"), "conv_id": table.column("conv_id"), "depth": table.column("depth"),
            "parent_conv_id": pa.compute.coalesce(outer, pa.chunked_array([named])), "n_convs": table.column("n_convs"), "n_children": pa.array(children[slot]),
            "n_leaves": pa.array(leaves[slot]), "saved_tokens": pa.array(saved[slot]), "outer": pa.compute.is_valid(outer),
        }
    )


def _top(heavy: DataFrame, summed: DataFrame) -> DataFrame:
    """The nodes on top with the sums over their subtrees, by doubling."""
    below = summed.where("outer").groupBy("parent").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    beside = heavy.where("depth > 0").groupBy("parent").agg(F.count("*").alias("c"), F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("s"))
    given = below.unionByName(beside).groupBy(F.col("parent").alias("digest")).agg(*(F.sum(c).alias(c) for c in "cls"))
    own = heavy.join(given, "digest", "left").fillna(0, ["c", "l", "s"])
    own = own.withColumn("l", F.col("l") + (F.col("c") == 0).cast("long")).withColumn("s", F.col("s") + (F.col("n_convs") - 1) * F.col("size"))
    above = heavy.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    fixed = own.join(above, "parent", "left").select("digest", "conv_id", "depth", "parent_conv_id", "n_convs", F.col("c").alias("n_children"))
    state = base.materialise(own.select("digest", F.when(F.col("depth") > 0, F.col("parent")).alias("up"), "l", "s"), "top")
    while not state.where("up IS NOT NULL").isEmpty():
        gain = state.where("up IS NOT NULL").groupBy(F.col("up").alias("digest")).agg(F.sum("l").alias("gl"), F.sum("s").alias("gs"))
        jump = state.select(F.col("digest").alias("up"), F.col("up").alias("next"))
        state = state.join(gain, "digest", "left").join(jump, "up", "left")
        state = base.materialise(state.select("digest", F.col("next").alias("up"), (F.col("l") + F.coalesce("gl", F.lit(0))).alias("l"), (F.col("s") + F.coalesce("gs", F.lit(0))).alias("s")), "top")
    return fixed.join(state.select("digest", F.col("l").alias("n_leaves"), F.col("s").alias("saved_tokens")), "digest")


def _ends(rows: DataFrame) -> DataFrame:
    """digest and ends_sha256 of rows (digest, conv_id): ids of a narrow range are joined, then each node's texts pass one after the other."""
    part = F.floor(F.col("conv_id") / IDS).alias("part")
    texts = rows.groupBy("digest", part).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    schema = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches):
        at, held = None, None
        for batch in batches:
            done = []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest != at:
                    if held:
                        done.append((at, held.hexdigest()))
                    at, held = digest, hashlib.sha256(ids.encode())
                else:
                    held.update(b"," + ids.encode())
            if done:
                yield base.batch_of(dict(zip(schema.names, zip(*done, strict=True), strict=True)), schema)
        if held:
            yield base.batch_of({"digest": [at], "ends_sha256": [held.hexdigest()]}, schema)

    return base.arrow_map(texts.repartition("digest").sortWithinPartitions("digest", "part"), run, "digest binary, ends_sha256 string")


def nodes(conversations: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations."""
    turns, convs = rebuilt(conversations)
    rows = prefixes(turns, block)
    weight = F.sum(F.col("length") - F.col("depth") + 1)
    first = [F.first(c).alias(c) for c in ("depth", "parent", "size")]
    made = rows.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), weight.alias("weight"), *first)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("digest"), "conv_id", "n_convs", F.lit(1 << 62).cast("long").alias("weight"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("size"))
    made = base.materialise(made.unionByName(root), "nodes")
    heavy, total = made.where(F.col("weight") > limit), made.count()

    above = heavy.select(F.col("digest").alias("parent"), F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("n"))
    light = base.materialise(base.spread_join(made.where(F.col("weight") <= limit), above, "parent", "digest", total, how="left"), "nodes")
    pieces = light.where("up_conv IS NOT NULL").select("digest")
    piece_of = rows.select("conv_id", "digest").join(pieces, "digest").select("conv_id", F.col("digest").alias("piece"))
    shards = max(64, math.ceil(total / SHARD))
    dealt = light.join(piece_of, "conv_id").withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards)))
    out = "digest binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, outer boolean"
    summed = base.materialise(dealt.groupBy("shard").applyInArrow(_summed, out), "summed")

    ends = rows.where("depth = length").select("digest", "conv_id").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("digest"), "conv_id"))
    all_ = summed.drop("parent", "outer").unionByName(_top(heavy, summed))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return all_.join(_ends(ends), "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nobody)).select(*_OUT)
