"""Fixpoints and bounded path expansion over edge tables.

Reachability is semi-naive: each round joins only the new nodes with the edges and drops
those already seen. A round's result is checkpointed, so plans stay short and a lost
executor costs one round. Edge tables are (src, dst); no side is broadcast by hand, the
planner does that where sizes allow.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.storage import checkpointed, written

#: Rounds after which the tables of earlier rounds are folded into one.
FOLD = 8


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reachable(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, depth): nodes that edges lead to from the seeds (node), with the least number of steps."""
    edges = checkpointed(edges.select("src", "dst").distinct())  # made once, not in every round
    frontier = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while max_rounds is None or depth < max_rounds:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % FOLD == 0:  # one table again, so that a round doesn't read all earlier ones
            seen = checkpointed(seen)
    return seen


def closure(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(src, dst, depth): all pairs connected by one or more edges, with the least number of steps."""
    seen = frontier = checkpointed(edges.select("src", "dst").distinct().withColumn("depth", F.lit(1)))
    depth, hop = 1, seen.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    while max_rounds is None or depth < max_rounds:
        depth += 1
        step = frontier.join(hop, "dst").select("src", F.col("next").alias("dst")).distinct()
        frontier = checkpointed(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, emit_cycles: bool = False, min_nodes: int = 1) -> DataFrame:
    """(path, kind): walks without repeated nodes from the starts (node) to a node without edges.

    kind is "complete"; with emit_cycles also "cyclic" for a path that would repeat its next
    node; "truncated" for one that still has edges at max_depth. Without max_depth all paths
    are followed to their end.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    paths = checkpointed(starts.select(F.array("node").alias("path")).distinct())
    done = []
    for depth in itertools.count():
        # one pass: a path without successors has a null
        out = paths.join(edges, F.element_at("path", -1) == edges["src"], "left")
        done.append(out.where("dst IS NULL").select("path", F.lit("complete").alias("kind")))
        if depth == max_depth:
            done.append(out.where("dst IS NOT NULL").select("path").distinct().withColumn("kind", F.lit("truncated")))
            break
        if emit_cycles:
            done.append(out.where(F.array_contains("path", F.col("dst"))).select("path", F.lit("cyclic").alias("kind")).distinct())
        paths = checkpointed(out.where("dst IS NOT NULL").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.where(F.size("path") >= min_nodes)


def caller_paths(edges: DataFrame, sinks: DataFrame, fanout: dict[int, int] | None = None, default: int = 1, max_depth: int = 50) -> DataFrame:
    """(path, depth): backward paths from the sinks (node), entry first, with a limit of callers for each depth.

    Callers are ranked by name once, so the limit is the same at every run. A path whose
    ranked callers are all on it already, or that is longer than max_depth, emits nothing.
    """
    from pyspark.sql import Window

    fanout = {1: 5, 2: 3} if fanout is None else fanout
    calls = reversed_edges(edges).distinct()
    calls = calls.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    calls = checkpointed(calls.where(F.col("rank") <= max([default, *fanout.values()])))
    paths, done = checkpointed(sinks.select(F.array("node").alias("path")).distinct()), []
    for depth in range(max_depth + 1):
        # one join: a path without callers has a null
        out = paths.join(calls, F.element_at("path", -1) == calls["src"], "left")
        done.append(out.where("dst IS NULL").select(F.reverse("path").alias("path"), F.lit(depth).alias("depth")))
        grown = out.where("dst IS NOT NULL").where((F.col("rank") <= fanout.get(depth, default)) & ~F.array_contains("path", F.col("dst")))
        paths = checkpointed(grown.select(F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def bounded_walks(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, visits: int = 2, limit: int | None = 100) -> DataFrame:
    """(start, path): walks that visit no node more than so many times, at most limit for each start, to nodes without edges.

    Shorter walks come first, so a start is done with the step that fills its limit, and
    nodes that lead to no end are not entered. Without max_depth walks are followed to their
    end; with it, longer ones are left out.
    """
    from pyspark.sql import Window

    edges = checkpointed(edges.select("src", "dst").distinct())
    sources = checkpointed(edges.select("src").distinct())
    ends = edges.join(sources.select(F.col("src").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("node"))
    leads = reachable(reversed_edges(edges), ends).select(F.col("node").alias("dst"))
    steps = checkpointed(edges.join(leads, "dst", "left_semi").select("src", "dst"))
    paths, done = checkpointed(starts.select(F.col("node").alias("start"), F.array("node").alias("path")).distinct()), []
    counts = None
    for depth in itertools.count():
        last = F.element_at("path", -1)
        done.append(checkpointed(paths.join(sources, last == sources["src"], "left_anti").select("start", "path")))
        if depth == max_depth:
            break
        if limit is not None:
            more = done[-1].groupBy("start").agg(F.count("*").alias("n"))
            counts = checkpointed(more if counts is None else counts.unionByName(more).groupBy("start").agg(F.sum("n").alias("n")))
            paths = paths.join(counts.where(F.col("n") >= limit).select("start"), "start", "left_anti")
        fits = F.size("path") - F.size(F.array_remove("path", F.col("dst"))) < visits
        grown = paths.join(steps, last == steps["src"]).where(fits)
        paths = checkpointed(grown.select("start", F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    if limit is None:
        return found
    rank = F.row_number().over(Window.partitionBy("start").orderBy(F.size("path"), F.concat_ws(">", F.transform("path", lambda x: F.lpad(x.cast("string"), 12, "0")))))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(method, node, dominator) of method graphs (method, src, dst) with entries (method, node).

    A method's graph is small and worked on as a whole, with a bit mask for each node; methods
    are spread over the cluster. Swap src and dst and give the exits for postdominators.
    """
    rows = edges.selectExpr("method", "src", "dst").unionByName(entries.selectExpr("method", "CAST(NULL AS BIGINT) AS src", "CAST(node AS BIGINT) AS dst"))

    def solve(table):
        import pandas as pd

        succ, preds, roots = {}, {}, []
        for src, dst in zip(table["src"], table["dst"], strict=True):
            if pd.isna(src):
                roots.append(int(dst))
            else:
                succ.setdefault(int(src), []).append(int(dst))
        order, stack, seen = [], [iter(sorted(roots))], set()
        trail = []
        while stack:  # depth first, so that the masks settle in few rounds
            node = next((n for n in stack[-1] if n not in seen), None)
            if node is None:
                stack.pop()
                if trail:
                    order.append(trail.pop())
                continue
            seen.add(node)
            trail.append(node)
            stack.append(iter(sorted(succ.get(node, ()))))
        order.reverse()
        bit = {n: i for i, n in enumerate(order)}
        for n in order:
            for m in succ.get(n, ()):
                preds.setdefault(m, []).append(n)
        every = (1 << len(order)) - 1
        doms = {n: 1 << bit[n] if n in roots else every for n in order}
        changed = True
        while changed:
            changed = False
            for n in order:
                if n in roots:
                    continue
                mask = every
                for m in preds[n]:
                    mask &= doms[m]
                mask |= 1 << bit[n]
                if mask != doms[n]:
                    doms[n], changed = mask, True
        found = [(table["method"].iloc[0], n, d) for n in order for d in order if doms[n] >> bit[d] & 1]
        return pd.DataFrame(found, columns=["method", "node", "dominator"])

    kind = dict(edges.dtypes)["method"]
    return rows.withColumn("src", F.col("src").cast("long")).withColumn("dst", F.col("dst").cast("long")).groupBy("method").applyInPandas(solve, f"method {kind}, node long, dominator long")


def matched_walks(edges: DataFrame, calls: DataFrame, starts: DataFrame, max_calls: int, visits: int = 1) -> DataFrame:
    """(path, calls): walks over successors, calls and their own returns, from the starts (node) to an end with no call open.

    edges are (src, dst) within methods, calls (src, dst) from call nodes to callees' first
    nodes. Each walk carries the stack of its open calls: at a node without successors it
    goes on after the call on top, and with none open it is done. A call with max_calls open
    is stepped over. Walks in which a node comes more than visits times are left out; calls is
    the number of calls entered.
    """
    edges = written(edges.select("src", F.col("dst").alias("succ")).distinct(), "edges")
    calls = written(calls.select("src", F.col("dst").alias("callee")).distinct(), "calls")
    ends = written(edges.select(F.col("succ").alias("node")).unionByName(starts.select("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti"), "ends")
    kind = dict(starts.dtypes)["node"]
    walks, done = written(starts.select(F.array("node").alias("path"), F.array().cast(f"array<{kind}>").alias("stack"), F.lit(0).alias("calls")).distinct(), "walks"), []
    while not walks.isEmpty():
        at = walks.withColumn("last", F.element_at("path", -1))
        over = at.join(ends, F.col("last") == ends["node"], "left").withColumn("ended", F.col("node").isNotNull()).drop("node")
        done.append(over.where("ended AND size(stack) = 0").select("path", "calls"))
        back = over.where("ended AND size(stack) > 0").withColumn("from", F.element_at("stack", -1)).withColumn("stack", F.expr("slice(stack, 1, size(stack) - 1)"))
        on = over.where("NOT ended").join(calls, F.col("last") == calls["src"], "left").drop("src")
        into = on.where(f"callee IS NOT NULL AND size(stack) < {max_calls}")
        past = on.where(f"callee IS NULL OR size(stack) >= {max_calls}").withColumn("from", F.col("last"))
        same = ["path", "stack", "calls", "from"]
        stepped = back.select(*same).unionByName(past.select(*same)).distinct().join(edges, F.col("from") == edges["src"])
        grown = stepped.select("path", "stack", "calls", F.col("succ").alias("next"))
        grown = grown.unionByName(into.select("path", F.concat("stack", F.array("last")).alias("stack"), (F.col("calls") + 1).alias("calls"), F.col("callee").alias("next")))
        grown = grown.where(F.size("path") - F.size(F.array_remove("path", F.col("next"))) < visits)
        walks = written(grown.select(F.concat("path", F.array("next")).alias("path"), "stack", "calls"), "walks")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found
