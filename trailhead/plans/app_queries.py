"""Whole-app graphs, block and composite paths on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhead.operators import appgraph, cfg
from trailhead.plans import binding as b
from trailhead.plans.graph_queries import _LEADERS, _text
from trailhead.plans.registry import query

_CALLS = "calls AS (SELECT DISTINCT method AS src, CAST(callee AS BIGINT) AS dst FROM stmt WHERE kind = 'METHOD_CALL')"


def calls_of(stmts):
    return stmts.where("kind = 'METHOD_CALL'").select(F.col("method").alias("src"), F.col("callee").cast("long").alias("dst")).distinct()


@query(
    b.with_sql("stmt", recursive=True)[:-1] + f", {_CALLS}" + ", a(method, type) AS (SELECT method, callee % 7 FROM stmt WHERE kind = 'ALLOCATION' UNION SELECT c.src, a.type FROM a JOIN calls c ON c.dst = a.method) SELECT method, type FROM a"
)
def allocated_types(spark, sf):
    """Types that each method allocates, itself or through calls."""
    stmts = b.statements(spark, sf)
    return appgraph.allocations(stmts.withColumn("callee", F.when(F.col("kind") == "ALLOCATION", F.col("callee") % 7).otherwise(F.col("callee"))), calls_of(stmts))


@query(
    b.with_sql("stmt")[:-1]
    + f""", {_CALLS}, nxt AS (SELECT *, lead(stmt_id) OVER w AS succ, lead(kind) OVER w AS to_kind FROM stmt WINDOW w AS (PARTITION BY method ORDER BY ordinal))
    SELECT 'main' AS src, 'k' || CAST(method % 5 AS VARCHAR) AS dst, 'component' AS kind FROM stmt GROUP BY ALL
    UNION ALL SELECT DISTINCT 'k' || CAST(method % 5 AS VARCHAR), 'm' || CAST(method AS VARCHAR), 'lifecycle' FROM stmt
    UNION ALL SELECT 'm' || CAST(method AS VARCHAR), 's' || CAST(stmt_id AS VARCHAR), 'entry' FROM stmt WHERE ordinal = 1
    UNION ALL SELECT 's' || CAST(stmt_id AS VARCHAR), 's' || CAST(succ AS VARCHAR), CASE WHEN kind IN ('IF_CONDITION', 'SWITCH') THEN 'branch' WHEN to_kind = 'METHOD_CALL' THEN 'to_call' ELSE 'sequence' END FROM nxt WHERE succ IS NOT NULL
    UNION ALL SELECT 's' || CAST(stmt_id AS VARCHAR), 'm' || CAST(callee AS VARCHAR), 'call' FROM stmt WHERE kind = 'METHOD_CALL' AND callee IN (SELECT method FROM stmt)
    UNION ALL SELECT 'm' || CAST(src AS VARCHAR), 'm' || CAST(dst AS VARCHAR), 'call_graph' FROM calls"""
)
def complete_graph(spark, sf):
    """Typed edges of the whole-app graph; a component is a fifth of the methods."""
    stmts = b.statements(spark, sf)
    components = stmts.select(F.concat(F.lit("k"), (F.col("method") % 5).cast("string")).alias("component"), "method").distinct()
    return appgraph.typed_edges(stmts, calls_of(stmts), components)


@query(
    b.with_sql("stmt", recursive=True)[:-1] + _LEADERS
    + """, spans AS (SELECT method, block, MIN(ordinal) AS low, MAX(ordinal) AS high FROM numbered GROUP BY method, block),
    jumps AS (SELECT DISTINCT s.method, s.block, t.block AS succ FROM spans s JOIN flow f ON f.method = s.method AND f.src = s.high JOIN numbered t ON t.method = f.method AND t.ordinal = f.dst),
    p(method, path) AS (SELECT method, [block] FROM spans WHERE low = 1 UNION ALL SELECT p.method, list_append(path, j.succ) FROM p JOIN jumps j ON j.method = p.method AND j.block = path[-1] WHERE NOT list_contains(path, j.succ) AND len(path) < 8),
    e AS (SELECT p.*, EXISTS (SELECT 1 FROM jumps j WHERE j.method = p.method AND j.block = path[-1]) AS open FROM p)
    SELECT method, array_to_string(path, '>') AS path, NOT open AS complete FROM e WHERE NOT open OR len(path) = 8"""
)
def block_paths(spark, sf):
    """Paths of up to eight blocks from each method's entry."""
    made = appgraph.block_paths(cfg.blocks(b.statements(spark, sf)), 8)
    return made.select("method", _text().alias("path"), "complete")


@query(
    b.with_sql("stmt", recursive=True)[:-1]
    + """, f AS (SELECT method, arg_min(CAST(callee AS BIGINT), ordinal) AS next FROM stmt WHERE kind = 'METHOD_CALL' GROUP BY method),
    s AS (SELECT f.method, f.next, k.method IS NOT NULL AS known FROM f LEFT JOIN f k ON k.method = f.next),
    p(path) AS (SELECT [CAST(method AS BIGINT)] FROM (SELECT DISTINCT method FROM stmt) r UNION ALL SELECT list_append(path, s.next) FROM p JOIN s ON s.method = path[-1] WHERE s.known AND NOT list_contains(path, s.next) AND len(path) < 51)
    SELECT array_to_string(path, '>') AS path, CASE WHEN s.next IS NULL THEN 'no call' WHEN NOT s.known THEN 'outside' WHEN list_contains(path, s.next) THEN 'recursion' ELSE 'depth' END AS reason
    FROM p LEFT JOIN s ON s.method = path[-1] WHERE s.next IS NULL OR NOT s.known OR list_contains(path, s.next) OR len(path) = 51"""
)
def composite_paths(spark, sf):
    """Chains through the first call site of each method."""
    stmts = b.statements(spark, sf)
    calls = stmts.where("kind = 'METHOD_CALL'").select("method", "ordinal", F.col("callee").cast("long").alias("callee"))
    made = appgraph.composite_paths(calls, stmts.select("method").distinct())
    return made.select(_text().alias("path"), "reason")
