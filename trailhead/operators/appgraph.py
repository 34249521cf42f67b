"""Whole-app graphs: typed edges, block and composite paths, closures over calls, merging of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhead.operators import constraints
from trailhead.storage import checkpointed


def allocations(stmts: DataFrame, calls: DataFrame) -> DataFrame:
    """(method, type): types that a method or any method it leads to allocates.

    stmts: (method, kind, callee) where an ALLOCATION names its type as callee; calls: (src, dst).
    """
    own = stmts.where("kind = 'ALLOCATION'").select("method", F.col("callee").alias("type")).distinct()
    seen = frontier = checkpointed(own)
    calls = checkpointed(calls.select("src", "dst").distinct())
    while True:
        step = frontier.join(calls, frontier["method"] == calls["dst"]).select(F.col("src").alias("method"), "type").distinct()
        frontier = checkpointed(step.join(seen, ["method", "type"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def typed_edges(stmts: DataFrame, calls: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst, kind) of the complete graph: main to components to methods, statement order, and calls into methods.

    stmts: (method, ordinal, stmt_id, kind, callee); calls: (src, dst); components: (component, method).
    """
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), kind.alias("kind")).distinct()
    tops = edge(components, F.lit("main"), F.col("component"), F.lit("component")).unionByName(edge(components, F.col("component"), text("m", "method"), F.lit("lifecycle")))
    linear = constraints.allocation_graph(stmts).where("succ <> 'EXIT'").join(stmts.select(F.col("stmt_id").cast("string").alias("succ"), F.col("kind").alias("to")), "succ")
    branch = F.when(F.col("kind").isin(*constraints.CONDITIONS), "branch").when(F.col("to") == "METHOD_CALL", "to_call").otherwise("sequence")
    inner = edge(linear, text("s", "stmt_id"), F.concat(F.lit("s"), "succ"), branch)
    first = stmts.where("ordinal = 1")
    enter = edge(first, text("m", "method"), text("s", "stmt_id"), F.lit("entry"))
    known = stmts.select(F.col("method").cast("long").alias("callee")).distinct()
    invoke = edge(stmts.where("kind = 'METHOD_CALL'").withColumn("callee", F.col("callee").cast("long")).join(known, "callee"), text("s", "stmt_id"), text("m", "callee"), F.lit("call"))
    return tops.unionByName(enter).unionByName(inner).unionByName(invoke).unionByName(edge(calls, text("m", "src"), text("m", "dst"), F.lit("call_graph")))


def block_paths(blocks: DataFrame, max_blocks: int) -> DataFrame:
    """(method, path, complete): paths of blocks from each method's entry without repeats.

    blocks: (method, block, is_entry, is_exit, succ). Paths at max_blocks that are not at an
    exit yet are kept with complete false.
    """
    blocks = checkpointed(blocks.select("method", "block", "is_entry", "is_exit", "succ"))
    edges = blocks.select("method", F.col("block").alias("src"), F.explode("succ").alias("dst"))
    exits = blocks.where("is_exit").select("method", F.col("block").alias("last"), F.lit(True).alias("complete"))
    paths = checkpointed(blocks.where("is_entry").select("method", F.array("block").alias("path")))
    done = []
    for length in range(1, max_blocks + 1):
        ended = paths.withColumn("last", F.element_at("path", -1)).join(exits, ["method", "last"], "left")
        done.append(ended.where("complete OR " + ("true" if length == max_blocks else "false")).select("method", "path", F.coalesce("complete", F.lit(False)).alias("complete")))
        if length == max_blocks:
            break
        grown = paths.withColumn("src", F.element_at("path", -1)).join(edges, ["method", "src"]).where(~F.array_contains("path", F.col("dst")))
        paths = checkpointed(grown.select("method", F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def composite_paths(calls: DataFrame, roots: DataFrame, max_depth: int = 50) -> DataFrame:
    """(path, reason): from each root follow the first call site of each method into its callee.

    calls: (method, ordinal, callee). A path ends where a method has no call site ("no call"),
    where its callee is not known ("outside"), where the callee is on the path ("recursion") or
    at the depth ("depth"). Later call sites of a caller are not expanded.
    """
    first = calls.groupBy("method").agg(F.min_by("callee", "ordinal").alias("next"))
    known = calls.select("method").distinct().withColumn("known", F.lit(True))
    step = checkpointed(first.join(known.select(F.col("method").alias("next"), "known"), "next", "left"))
    paths, done = checkpointed(roots.select(F.array(F.col("method").cast("long")).alias("path")).distinct()), []
    for depth in range(max_depth + 1):
        out = paths.withColumn("method", F.element_at("path", -1)).join(step, "method", "left")
        again = F.array_contains("path", F.col("next").cast("long"))
        reason = F.when(F.col("next").isNull(), "no call").when(F.col("known").isNull(), "outside").when(again, "recursion")
        reason = F.coalesce(reason, F.lit("depth")) if depth == max_depth else reason
        out = out.withColumn("reason", reason)
        done.append(out.where("reason IS NOT NULL").select("path", "reason"))
        paths = checkpointed(out.where("reason IS NULL").select(F.concat("path", F.array(F.col("next").cast("long"))).alias("path")))
        if paths.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def component_methods(calls: DataFrame, components: DataFrame) -> DataFrame:
    """(component, method): each component's own methods and those they lead to; the frontier holds pairs of components and methods only."""
    seen = frontier = checkpointed(components.select("component", "method").distinct())
    calls = checkpointed(calls.select("src", "dst").distinct())
    while True:
        step = frontier.join(calls, frontier["method"] == calls["src"]).select("component", F.col("dst").alias("method")).distinct()
        frontier = checkpointed(step.join(seen, ["component", "method"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def sink_leading(calls: DataFrame, edges: DataFrame, reach: DataFrame, sinks: DataFrame) -> DataFrame:
    """Calls (method, callee, ...) that lead to a sink (node): into it, or into a method of reach (node) that the call graph has them call."""
    direct = calls.join(sinks.select(F.col("node").alias("callee")).distinct(), "callee", "left_semi")
    others = calls.join(sinks.select(F.col("node").alias("callee")).distinct(), "callee", "left_anti")
    known = edges.join(reach.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("method"), F.col("dst").alias("callee")).distinct()
    return direct.unionByName(others.join(known, ["method", "callee"], "left_semi"))


def contains_sink(paths: DataFrame, sinks: DataFrame) -> DataFrame:
    """Paths (path_id, path) any of whose nodes is a sink (node)."""
    hit = paths.select("path_id", F.explode("path").alias("node")).join(sinks, "node", "left_semi").select("path_id").distinct()
    return paths.join(hit, "path_id", "left_semi")


def cyclic(path: str) -> Column:
    return F.size(F.array_distinct(path)) < F.size(path)


def merged(left: Column, right: Column) -> Column:
    """Two path structs (path_id, target, methods, constraints, metadata) as one; null where their targets differ.

    Constraints of the right path are added up to the first that conflicts, which makes the path invalid.
    """
    clash = F.transform(right["constraints"], lambda y: F.exists(left["constraints"], lambda x: constraints.conflict(x, y)))
    at = F.coalesce(F.array_position(clash, True), F.lit(0))
    kept = F.when(at == 0, right["constraints"]).otherwise(F.slice(right["constraints"], F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0))))
    made = F.struct(
        F.concat(left["path_id"], F.lit("+"), right["path_id"]).alias("path_id"), left["target"].alias("target"), F.array_union(left["methods"], right["methods"]).alias("methods"),
        F.concat(left["constraints"], kept).alias("constraints"), (at == 0).alias("valid"), F.map_concat(F.map_filter(left["metadata"], lambda k, _: ~F.map_contains_key(right["metadata"], k)), right["metadata"]).alias("metadata"), F.lit("MERGED").alias("path_type"),
    )
    return F.when(left["target"] == right["target"], made)


def described(paths: DataFrame) -> DataFrame:
    """(path_id, value): a readable text of each path (path_id, target, methods, constraints, valid)."""
    steps = F.transform("methods", lambda m, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), m))
    value = F.concat_ws("\n", F.concat(F.lit("Target: "), "target"), F.concat(F.lit("Valid: "), F.col("valid").cast("string")), F.concat(F.lit("Constraints: "), constraints.combined("constraints")), F.lit("Methods:"), F.array_join(steps, "\n"))
    return paths.select("path_id", value.alias("value"))


def argument_map(calls: DataFrame, formals: DataFrame, virtual: DataFrame | None = None) -> DataFrame:
    """(call, callee, actual, formal): arguments by position; virtual edges (callee, target, position, formal) such as a
    thread's start lead to other methods with a mapping of their own."""
    actual = calls.select("call", "callee", F.posexplode("args").alias("position", "actual"))
    plain = actual.join(formals.select("callee", F.posexplode("names").alias("position", "formal")), ["callee", "position"]).select("call", "callee", "actual", "formal")
    if virtual is None:
        return plain
    return plain.unionByName(actual.join(virtual, ["callee", "position"]).select("call", F.col("target").alias("callee"), "actual", "formal"))
