"""Taint of list positions and map keys, and variables that surely hold the same object, along straight-line code.

Operations of a variable, or statements of a block, are folded in order within one array of theirs,
so nothing but the grouping is shuffled and all expressions stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhead.functions import containers

#: The upper bound of positions; an interval up to it is open.
TOP = 2**31 - 1
UNKNOWN = "*"
_PLACES = "array<struct<min: int, max: int>>"
_READS = "array<struct<ordinal: bigint, leak: boolean>>"


def _moved(place: Column, low: Column, high: Column, by: int) -> Column:
    """An interval whose bounds move where they are at or after a place; high bounds may move from low on only."""
    bound = lambda c, at: F.when((c == TOP) | (c < at), c).otherwise(F.greatest(c + by, F.lit(0)))
    return containers.interval(bound(place["min"], high), bound(place["max"], low))


def _folded(ops: DataFrame, state: str, start: Column, step) -> DataFrame:
    """(method, var, ordinal, leak) of the reads of each variable; step gives the new state, and whether a read leaks."""
    op = F.struct(F.col("ordinal").cast("long").alias("ordinal"), "op", "at", "tainted")
    rows = ops.groupBy("method", "var").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    first = F.struct(start.cast(state).alias("state"), F.array().cast(_READS).alias("reads"))

    def one(s, o):
        made, leak = step(s["state"], o)
        read = F.struct(o["ordinal"].alias("ordinal"), leak.alias("leak"))
        return F.struct(made.cast(state).alias("state"), F.when(o["op"] == "get", F.concat(s["reads"], F.array(read))).otherwise(s["reads"]).cast(_READS).alias("reads"))

    return rows.withColumn("r", F.explode(F.aggregate("ops", first, one)["reads"])).select("method", "var", "r.ordinal", "r.leak")


def list_reads(ops: DataFrame, smash: bool = False, widen: bool = False) -> DataFrame:
    """(method, var, ordinal, leak): whether each read of a list may give a tainted value.

    ops: (method, var, ordinal, op, at, tainted) with op new, clear, add (puts a value before the one at a
    place and moves the rest), set, remove, get or other; at is the place, null where it is not known. smash
    taints the whole list by any tainted value. widen opens an interval whenever it moves, so that loops end.
    """
    none = F.array().cast(_PLACES)
    open_ = containers.interval(F.lit(0), F.lit(TOP))

    def step(places, o):
        known = o["at"].isNotNull() & ~F.lit(smash)
        at = F.coalesce(o["at"].cast("int"), F.lit(0))
        here = F.when(known, containers.interval(at, at)).otherwise(open_)
        put = F.when(o["tainted"], F.array(here)).otherwise(none)
        opened = lambda old, new: F.when((old == new) | ~F.lit(widen), new).otherwise(open_)
        move = lambda low, high, by: (lambda p: opened(p, _moved(p, low, high, by)))
        same = lambda p: known & (p["min"] == at) & (p["max"] == at)
        top = F.lit(TOP)
        added = F.transform(places, move(F.when(known, at).otherwise(0), F.when(known, at).otherwise(top), 1))
        left = F.filter(places, lambda p: ~same(p))
        removed = F.transform(left, move(F.when(known, at + 1).otherwise(top), F.when(known, at + 1).otherwise(0), -1))
        kept = F.when(F.lit(smash), places)
        made = (
            F.when(o["op"].isin("new", "clear"), none).when(o["op"] == "add", F.array_union(F.coalesce(kept, added), put))
            .when(o["op"] == "set", F.array_union(F.coalesce(kept, left), put)).when(o["op"] == "remove", F.array_distinct(F.coalesce(kept, removed))).otherwise(places)
        )
        return made, F.exists(places, lambda p: F.coalesce(containers.intersects(p, here), F.lit(True)))

    return _folded(ops, _PLACES, none, step)


def map_reads(ops: DataFrame, smash: bool = False) -> DataFrame:
    """The same for maps, where at is a constant key or null: a known key that gets a clean value is clean again."""
    none = F.array().cast("array<string>")

    def step(keys, o):
        known = o["at"].isNotNull() & ~F.lit(smash)
        key = F.when(known, o["at"].cast("string")).otherwise(UNKNOWN)
        left = F.when(known, F.filter(keys, lambda k: k != key)).otherwise(keys)
        put = F.when(o["tainted"], F.array_union(left, F.array(key))).otherwise(left)
        made = F.when(o["op"].isin("new", "clear"), none).when(o["op"].isin("add", "set"), put).when(o["op"] == "remove", left).otherwise(keys)
        return made, F.when(known, F.array_contains(keys, key) | F.array_contains(keys, UNKNOWN)).otherwise(F.size(keys) > 0)

    return _folded(ops, "array<string>", none, step)


def must_alias(stmts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (method, block, ordinal, a, b) with must: both variables surely hold the same object before the statement.

    stmts: (method, block, ordinal, lhs, rhs) in straight-line blocks; a copy has the rhs it copies, any other
    definition a null. A variable that the block has not defined holds what it held at its start.
    """
    rows = stmts.where("lhs IS NOT NULL").select("method", "block", F.struct(F.col("ordinal").cast("long").alias("ordinal"), "lhs", "rhs").alias("s"))
    blocks = rows.groupBy("method", "block").agg(F.array_sort(F.collect_list("s")).alias("defs"))
    held = lambda m, v: F.coalesce(F.try_element_at(m, v), F.concat(F.lit("start of "), v))
    kind = "map<string, string>"

    def define(m, s):
        value = F.when(s["rhs"].isNull(), F.concat(F.lit("made at "), s["ordinal"].cast("string"))).otherwise(held(m, s["rhs"]))
        return F.map_concat(F.map_filter(m, lambda k, _: k != s["lhs"]), F.map_from_arrays(F.array(s["lhs"]), F.array(value))).cast(kind)

    before = F.aggregate(F.filter("defs", lambda s: s["ordinal"] < F.col("ordinal")), F.create_map().cast(kind), define)
    found = asked.join(blocks, ["method", "block"], "left").withColumn("held", F.when(F.col("defs").isNotNull(), before).otherwise(F.create_map().cast(kind)))
    return found.select("method", "block", "ordinal", "a", "b", (held(F.col("held"), F.col("a")) == held(F.col("held"), F.col("b"))).alias("must"))
