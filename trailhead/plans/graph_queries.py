"""Reachability, paths, control flow and hierarchies on the derived program graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhead.operators import cfg, hierarchy, recursion
from trailhead.plans import binding as b
from trailhead.plans.registry import query


def _text(path="path"):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


_REACH = "r(node, depth) AS (SELECT node, 0 FROM sinks UNION SELECT e.src, r.depth + 1 FROM r JOIN edge e ON e.dst = r.node) "


@query(b.with_sql("edge", "sinks", recursive=True)[:-1] + ", " + _REACH + "SELECT node AS method_id, CAST(MIN(depth) AS INT) AS depth FROM r GROUP BY node")
def dangerous_reach(spark, sf):
    """Methods that can reach a dangerous one, with the least number of calls."""
    found = recursion.reachable(recursion.reversed_edges(b.edges(spark, sf)), b.sinks(spark, sf))
    return found.select(F.col("node").alias("method_id"), "depth")


@query(
    b.with_sql("edge_cyc", "sinks", recursive=True)[:-1]
    + ", r(node) AS (SELECT node FROM sinks UNION SELECT e.dst FROM r JOIN edge_cyc e ON e.src = r.node) SELECT node AS method_id FROM r"
)
def forward_reach_cyclic(spark, sf):
    """Methods that dangerous ones lead to, in a graph with cycles."""
    return recursion.reachable(b.edges_cyc(spark, sf), b.sinks(spark, sf)).select(F.col("node").alias("method_id"))


@query(
    b.with_sql("edge", "method", recursive=True)[:-1]
    + """, r(node, depth) AS (SELECT node, 0 FROM (SELECT method_id AS node FROM method WHERE dangerous) s UNION SELECT e.src, depth + 1 FROM r JOIN edge e ON e.dst = r.node),
    least AS (SELECT node, MIN(depth) AS depth FROM r GROUP BY node)
    SELECT depth, COUNT(*) AS methods, CAST(SUM(CASE WHEN e.dst IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS roots
    FROM (SELECT node, CAST(depth AS INT) AS depth FROM least) l LEFT JOIN (SELECT DISTINCT dst FROM edge) e ON e.dst = l.node GROUP BY depth"""
)
def reachability_summary(spark, sf):
    """Reachable methods and entry points (without callers) by depth."""
    edges = b.edges(spark, sf)
    found = recursion.reachable(recursion.reversed_edges(edges), b.sinks(spark, sf))
    called = edges.select(F.col("dst").alias("node")).distinct().withColumn("called", F.lit(1))
    return found.join(called, "node", "left").groupBy("depth").agg(F.count("*").alias("methods"), F.sum(F.when(F.col("called").isNull(), 1).otherwise(0)).alias("roots"))


@query(
    b.with_sql("edge") + "SELECT src, dst, CAST(MIN(depth) AS INT) AS depth FROM (SELECT src, dst, 1 AS depth FROM edge UNION ALL "
    "SELECT a.src, c.dst, 2 FROM edge a JOIN edge c ON a.dst = c.src) t GROUP BY src, dst"
)
def call_closure_two_steps(spark, sf):
    return recursion.closure(b.edges(spark, sf), max_rounds=2)


_RANKED = "calls AS (SELECT dst AS src, src AS dst, row_number() OVER (PARTITION BY dst ORDER BY src) AS rank FROM edge)"


@query(
    b.with_sql("edge", "sinks", recursive=True)[:-1]
    + f""", {_RANKED}, p(path, depth) AS (SELECT [node], 0 FROM sinks UNION ALL
    SELECT list_append(path, c.dst), depth + 1 FROM p JOIN calls c ON c.src = path[-1]
    WHERE rank <= CASE depth WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 1 END AND NOT list_contains(path, c.dst) AND depth < 50)
    SELECT array_to_string(list_reverse(path), '>') AS path, CAST(depth AS INT) AS depth, len(path) AS n_methods FROM p
    WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.src = path[-1])"""
)
def backward_constraint_paths(spark, sf):
    """Entry-to-sink chains with the caller limits 1, 5, 3, 1."""
    found = recursion.caller_paths(b.edges(spark, sf), b.sinks(spark, sf))
    return found.select(_text().alias("path"), "depth", F.size("path").cast("long").alias("n_methods"))


def _simple(relation, start, depth, cycles):
    """Oracle of simple_paths: all walks without repeats to the depth, with the kind of their end."""
    return (
        f""", p(path, depth) AS (SELECT [node], 0 FROM ({start}) s UNION ALL SELECT list_append(path, e.dst), depth + 1 FROM p JOIN {relation} e
        ON e.src = path[-1] WHERE NOT list_contains(path, e.dst) AND depth < {depth}),
        o AS (SELECT path, depth, e.dst FROM p LEFT JOIN {relation} e ON e.src = path[-1])
        SELECT array_to_string(path, '>') AS path, 'complete' AS kind FROM o WHERE dst IS NULL
        UNION ALL SELECT DISTINCT array_to_string(path, '>'), 'truncated' FROM o WHERE dst IS NOT NULL AND depth = {depth}"""
        + (f" UNION ALL SELECT DISTINCT array_to_string(path, '>'), 'cyclic' FROM o WHERE depth < {depth} AND list_contains(path, dst)" if cycles else "")
    )


@query(b.with_sql("edge", "sinks", recursive=True)[:-1] + _simple("edge", "SELECT node FROM sinks", 2, False))
def paths_to_leaves(spark, sf):
    """Simple paths from the sinks along calls, two steps deep."""
    return recursion.simple_paths(b.edges(spark, sf), b.sinks(spark, sf), 2).select(_text().alias("path"), "kind")


@query(
    b.with_sql("edge_cyc", "sinks", recursive=True)[:-1]
    + ", back AS (SELECT dst AS src, src AS dst FROM edge_cyc)" + _simple("back", "SELECT node FROM sinks", 2, True)
)
def reach_paths_with_cycles(spark, sf):
    """Backward paths that report a repeated caller as a cyclic path, two steps deep."""
    back = recursion.reversed_edges(b.edges_cyc(spark, sf))
    return recursion.simple_paths(back, b.sinks(spark, sf), 2, emit_cycles=True).select(_text().alias("path"), "kind")


@query(
    b.with_sql("edge", "sinks", recursive=True)[:-1]
    + """, p(start, path) AS (SELECT node, [node] FROM sinks UNION ALL SELECT start, list_append(path, e.dst) FROM p JOIN edge e ON e.src = path[-1] WHERE len(path) <= 2),
    ends AS (SELECT start, path FROM p WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.src = path[-1])),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path), array_to_string(list_transform(path, lambda x: lpad(CAST(x AS VARCHAR), 12, '0')), '>')) AS rank FROM ends)
    SELECT start, array_to_string(path, '>') AS path FROM ranked WHERE rank <= 100"""
)
def bounded_walks(spark, sf):
    """Walks of at most two steps and two visits a node, 100 for each start; longer ones are left out."""
    return recursion.bounded_walks(b.edges(spark, sf), b.sinks(spark, sf), 2).select("start", _text().alias("path"))


_FLOW = """flow AS (SELECT a.method, CAST(a.ordinal AS BIGINT) AS src, CAST(t.ordinal AS BIGINT) AS dst FROM stmt a JOIN stmt t ON a.method = t.method
  AND (t.ordinal = a.ordinal + 1 OR (a.kind = 'IF_CONDITION' AND t.ordinal = a.ordinal + 3) OR (a.kind = 'SWITCH' AND t.ordinal = a.ordinal + 2)))"""


@query(b.with_sql("stmt")[:-1] + ", " + _FLOW + " SELECT * FROM flow")
def control_flow_edges(spark, sf):
    return cfg.flow_edges(b.statements(spark, sf))


@query(
    b.with_sql("stmt", recursive=True)[:-1] + ", " + _FLOW
    + """, avoid(method, without, node) AS (SELECT s.method, CAST(w.ordinal AS BIGINT), CAST(1 AS BIGINT) FROM (SELECT DISTINCT method FROM stmt) s JOIN stmt w ON w.method = s.method WHERE w.ordinal > 1
    UNION SELECT a.method, a.without, f.dst FROM avoid a JOIN flow f ON f.method = a.method AND f.src = a.node WHERE f.dst <> a.without)
    SELECT n.method, CAST(n.ordinal AS BIGINT) AS node, CAST(d.ordinal AS BIGINT) AS dominator FROM stmt n JOIN stmt d ON n.method = d.method
    WHERE NOT EXISTS (SELECT 1 FROM avoid a WHERE a.method = n.method AND a.without = d.ordinal AND a.node = n.ordinal)"""
)
def statement_dominators(spark, sf):
    stmts = b.statements(spark, sf)
    entries = stmts.where("ordinal = 1").select("method", F.col("ordinal").alias("node"))
    return recursion.dominators(cfg.flow_edges(stmts), entries)


_LEADERS = ", " + _FLOW + """, leads AS (SELECT s.method, s.ordinal, s.kind, CASE WHEN s.ordinal = 1 OR lag(kind) OVER (PARTITION BY s.method ORDER BY ordinal) IN ('IF_CONDITION', 'SWITCH') OR j.dst IS NOT NULL THEN 1 ELSE 0 END AS leader
  FROM stmt s LEFT JOIN (SELECT DISTINCT method, dst FROM flow WHERE dst > src + 1) j ON j.method = s.method AND j.dst = s.ordinal),
  numbered AS (SELECT *, CAST(SUM(leader) OVER (PARTITION BY method ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS INT) AS block FROM leads)"""


@query(
    b.with_sql("stmt")[:-1] + _LEADERS
    + """, spans AS (SELECT method, block, COUNT(*) AS n_units, MIN(ordinal) AS low, MAX(ordinal) AS high FROM numbered GROUP BY method, block),
    jumps AS (SELECT s.method, s.block, t.block AS succ FROM spans s JOIN flow f ON f.method = s.method AND f.src = s.high JOIN numbered t ON t.method = f.method AND t.ordinal = f.dst)
    SELECT s.method, s.block, s.n_units, s.low = 1 AS is_entry, j.succ IS NULL AS is_exit, COALESCE(j.succ, '') AS succ FROM spans s
    LEFT JOIN (SELECT method, block, string_agg(CAST(succ AS VARCHAR), ',' ORDER BY succ) AS succ FROM (SELECT DISTINCT * FROM jumps) d GROUP BY method, block) j ON j.method = s.method AND j.block = s.block"""
)
def basic_blocks(spark, sf):
    """Blocks of each method with their successors."""
    made = cfg.blocks(b.statements(spark, sf))
    return made.select("method", "block", "n_units", "is_entry", "is_exit", F.array_join(F.transform("succ", lambda x: x.cast("string")), ",").alias("succ"))


@query(
    b.with_sql("stmt")[:-1] + _LEADERS
    + """, spans AS (SELECT method, block, MAX(ordinal) AS high FROM numbered GROUP BY method, block),
    jumps AS (SELECT DISTINCT s.method, s.block, t.block AS succ FROM spans s JOIN flow f ON f.method = s.method AND f.src = s.high JOIN numbered t ON t.method = f.method AND t.ordinal = f.dst),
    calls AS (SELECT n.method, n.block, n.ordinal, s.callee, sp.high FROM numbered n JOIN stmt s ON s.method = n.method AND s.ordinal = n.ordinal JOIN spans sp ON sp.method = n.method AND sp.block = n.block
      WHERE n.kind = 'METHOD_CALL' AND s.callee IN (SELECT method FROM stmt)),
    exits AS (SELECT sp.method, sp.block FROM spans sp WHERE NOT EXISTS (SELECT 1 FROM jumps j WHERE j.method = sp.method AND j.block = sp.block)),
    back AS (SELECT c.method, c.block, c.callee, CASE WHEN c.ordinal < c.high THEN c.block ELSE (SELECT MIN(succ) FROM jumps j WHERE j.method = c.method AND j.block = c.block) END AS cont FROM calls c)
    SELECT method AS src_method, block AS src_block, method AS dst_method, succ AS dst_block, 'succ' AS kind FROM jumps
    UNION ALL SELECT DISTINCT method, block, CAST(callee AS BIGINT), 1, 'call' FROM calls
    UNION ALL SELECT DISTINCT CAST(k.callee AS BIGINT), e.block, k.method, k.cont, 'return' FROM back k JOIN exits e ON e.method = k.callee WHERE k.cont IS NOT NULL"""
)
def interprocedural_edges(spark, sf):
    """Successor, call and return edges between the blocks of all methods."""
    return cfg.interprocedural(b.statements(spark, sf))


_HIER = """class_edge AS (SELECT DISTINCT 'c' || CAST(c_custkey AS VARCHAR) AS sub, 'n' || CAST(c_nationkey AS VARCHAR) AS sup FROM customer
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation)"""
_CLOSED = _HIER + """, up(sub, sup, depth) AS (SELECT sub, sup, 1 FROM class_edge UNION SELECT u.sub, e.sup, u.depth + 1 FROM up u JOIN class_edge e ON e.sub = u.sup)"""


def class_edges(spark, sf):
    """(sub, sup): customers and suppliers below nations below regions."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = b.table(spark, sf, "customer").select(name("c", "c_custkey").alias("sub"), name("n", "c_nationkey").alias("sup"))
    rows = rows.unionByName(b.table(spark, sf, "supplier").select(name("s", "s_suppkey").alias("sub"), name("n", "s_nationkey").alias("sup")))
    return rows.unionByName(b.table(spark, sf, "nation").select(name("n", "n_nationkey").alias("sub"), name("r", "n_regionkey").alias("sup")))


@query(f"WITH RECURSIVE {_CLOSED} SELECT sub, sup, CAST(MIN(depth) AS INT) AS depth FROM up GROUP BY sub, sup")
def class_hierarchy_closure(spark, sf):
    return hierarchy.supertypes(class_edges(spark, sf))


@query(
    f"WITH RECURSIVE {_CLOSED}, kinds(sup, component, prio) AS (VALUES ('r0', 'Activity', 0), ('r1', 'Service', 1), ('r2', 'BroadcastReceiver', 2), ('r3', 'ContentProvider', 3)) "
    "SELECT c.sub AS class, COALESCE((SELECT component FROM up u JOIN kinds k ON k.sup = u.sup WHERE u.sub = c.sub ORDER BY u.depth, k.prio LIMIT 1), 'Other') AS component FROM (SELECT DISTINCT sub FROM class_edge) c"
)
def component_types(spark, sf):
    """Component of each class by its nearest known superclass."""
    kinds = spark.createDataFrame([("r0", "Activity", 0), ("r1", "Service", 1), ("r2", "BroadcastReceiver", 2), ("r3", "ContentProvider", 3)], "sup string, component string, prio int")
    return hierarchy.components(class_edges(spark, sf), kinds)


@query(
    f"WITH RECURSIVE {_CLOSED}, ok AS (SELECT sub, sup FROM up UNION SELECT sub, sub FROM class_edge UNION SELECT sup, sup FROM class_edge), "
    "casts AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS value_type, 'n' || CAST(s_nationkey AS VARCHAR) AS cast_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) "
    "SELECT value_type, cast_type, EXISTS (SELECT 1 FROM ok WHERE sub = value_type AND sup = cast_type) OR EXISTS (SELECT 1 FROM ok WHERE sub = cast_type AND sup = value_type) AS possible FROM casts"
)
def cast_checks(spark, sf):
    """Whether a value of one type can be cast to another: one must be below the other."""
    casts = (
        b.table(spark, sf, "orders").join(b.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(b.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("value_type"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("cast_type")).distinct()
    )
    return hierarchy.cast_possible(casts, class_edges(spark, sf))
