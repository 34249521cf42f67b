"""Control flow with branch targets as data: edges, blocks, dominators, walks with bounded loops, and calls matched with returns.

The code has bodies of up to ten statements; branches, jumps and handlers lead anywhere in
their body, also backwards.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailhead.operators import cfg, recursion
from trailhead.plans import binding as b
from trailhead.plans.graph_queries import _text
from trailhead.plans.registry import query

#: Text that both engines read; c0 has bodies, statements and the number of statements.
_BODY, _N = "method * 100 + CAST(floor((ordinal - 1) / 10) AS INT)", "1 + (ordinal - 1) % 10"
_KIND = "CASE kind WHEN 'ALLOCATION' THEN 'IF' WHEN 'SWITCH' THEN CASE callee % 4 WHEN 0 THEN 'GOTO' WHEN 1 THEN 'RETURN' WHEN 2 THEN 'SWITCH' ELSE 'THROW' END WHEN 'METHOD_CALL' THEN 'CALL' ELSE 'ASSIGN' END"
_FIRST, _SECOND, _HANDLER = "1 + (callee * 7 + n) % last", "1 + (callee * 3 + 4) % last", "1 + (CAST(body AS INT) * 5 + 3) % last"
_CODE = f"""c0 AS (SELECT *, CAST(max(n) OVER (PARTITION BY body) AS INT) AS last FROM (SELECT {_BODY} AS body, {_N} AS n, {_KIND} AS op, callee FROM stmt) t),
  code AS (SELECT body, n, op, callee, last, {_FIRST} AS t1, {_SECOND} AS t2, {_HANDLER} AS h FROM c0),
  ce AS (SELECT body, n AS src, n + 1 AS dst, 'next' AS kind FROM code WHERE op NOT IN ('GOTO', 'RETURN', 'THROW') AND n < last UNION SELECT body, n, t1, 'target' FROM code WHERE op IN ('IF', 'GOTO', 'SWITCH')
    UNION SELECT body, n, t2, 'target' FROM code WHERE op = 'SWITCH' UNION SELECT body, n, h, 'exception' FROM code WHERE op IN ('CALL', 'THROW') AND body % 3 = 0)"""
_BLOCKS = """, lead AS (SELECT c.body, c.n, c.op, CASE WHEN c.n = 1 OR lag(c.op) OVER (PARTITION BY c.body ORDER BY c.n) IN ('GOTO', 'RETURN', 'THROW', 'IF', 'SWITCH', 'CALL') OR t.dst IS NOT NULL THEN 1 ELSE 0 END AS leader
    FROM code c LEFT JOIN (SELECT DISTINCT body, dst FROM ce WHERE kind <> 'next') t ON t.body = c.body AND t.dst = c.n),
  num AS (SELECT *, CAST(sum(leader) OVER (PARTITION BY body ORDER BY n ROWS UNBOUNDED PRECEDING) AS INT) AS block FROM lead),
  blk AS (SELECT body, block, min(n) AS low, max(n) AS high FROM num GROUP BY ALL),
  be AS (SELECT DISTINCT e.body, a.block, z.block AS succ FROM ce e JOIN num a ON a.body = e.body AND a.n = e.src JOIN num z ON z.body = e.body AND z.n = e.dst AND z.leader = 1)"""
_NODES = """, node AS (SELECT body * 100 + block AS src, body * 100 + succ AS dst FROM be)"""
_BEGIN = b.with_sql("stmt", recursive=True)[:-1] + ", " + _CODE


def code(spark, sf):
    """(method, n, kind, targets, handler, callee) of the bodies."""
    rows = b.statements(spark, sf).selectExpr(f"{_BODY} AS body", f"CAST({_N} AS INT) AS n", f"{_KIND} AS op", "callee")
    rows = rows.withColumn("last", F.max("n").over(Window.partitionBy("body")))
    targets = f"CASE WHEN op IN ('IF', 'GOTO') THEN array({_FIRST}) WHEN op = 'SWITCH' THEN array({_FIRST}, {_SECOND}) END"
    return rows.selectExpr("body AS method", "n", "op AS kind", f"{targets} AS targets", f"CASE WHEN body % 3 = 0 THEN {_HANDLER} END AS handler", "callee")


@query(_BEGIN + " SELECT body AS method, src, dst, kind FROM ce")
def branch_edges(spark, sf):
    """Next, target and exceptional edges of all statements."""
    return cfg.code_edges(code(spark, sf))


@query(
    _BEGIN + _BLOCKS
    + " SELECT k.body AS method, k.block, k.low, k.high, coalesce(s.succ, '') AS succ FROM blk k LEFT JOIN (SELECT body, block, string_agg(CAST(succ AS VARCHAR), ',' ORDER BY succ) AS succ FROM be GROUP BY ALL) s ON s.body = k.body AND s.block = k.block"
)
def branch_blocks(spark, sf):
    """Basic blocks by real targets, with loops."""
    blocks, edges = cfg.code_blocks(code(spark, sf))
    succ = edges.groupBy("method", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("succ")), lambda x: x.cast("string")), ",").alias("succ"))
    return blocks.join(succ, ["method", "block"], "left").withColumn("succ", F.coalesce("succ", F.lit("")))


@query(
    _BEGIN
    + """, reach(body, node) AS (SELECT body, 1 FROM code WHERE n = 1 UNION SELECT r.body, e.dst FROM reach r JOIN ce e ON e.body = r.body AND e.src = r.node),
    avoid(body, without, node) AS (SELECT c.body, c.n, 1 FROM code c WHERE c.n > 1 UNION SELECT a.body, a.without, e.dst FROM avoid a JOIN ce e ON e.body = a.body AND e.src = a.node WHERE e.dst <> a.without)
    SELECT x.body AS method, CAST(x.node AS BIGINT) AS node, CAST(d.node AS BIGINT) AS dominator FROM reach x JOIN reach d ON d.body = x.body WHERE NOT EXISTS (SELECT 1 FROM avoid a WHERE a.body = x.body AND a.without = d.node AND a.node = x.node)"""
)
def branch_dominators(spark, sf):
    """Statements that lie on every way to a statement that can be reached, loops included."""
    rows = code(spark, sf)
    return recursion.dominators(cfg.code_edges(rows).select("method", "src", "dst"), rows.where("n = 1").select("method", F.col("n").alias("node")))


_VISITS = "len(list_filter(path, lambda y: y = e.dst)) < {n}"


def _walk_sql(visits):
    return (
        _BEGIN + _BLOCKS + _NODES
        + f""", w(path) AS (SELECT [body * 100 + 1] FROM (SELECT DISTINCT body FROM code) UNION ALL SELECT list_append(path, e.dst) FROM w JOIN node e ON e.src = path[-1] WHERE {_VISITS.format(n=visits)})
    SELECT path[1] // 100 AS method, array_to_string(list_transform(path, lambda x: x % 100), '>') AS path FROM w WHERE NOT EXISTS (SELECT 1 FROM node e WHERE e.src = path[-1])"""
    )


def _nodes(spark, sf):
    """Block graphs of all bodies with nodes body * 100 + block, and the first nodes."""
    rows = code(spark, sf)
    _, edges = cfg.code_blocks(rows)
    number = lambda c: (F.col("method") * 100 + F.col(c)).alias({"block": "src", "succ": "dst"}[c])
    return rows, edges.select(number("block"), number("succ")), rows.select((F.col("method") * 100 + 1).alias("node")).distinct()


def _shown(found):
    return found.select(F.floor(F.element_at("path", 1) / 100).cast("long").alias("method"), _text(F.transform("path", lambda x: x % 100)).alias("path"))


@query(_walk_sql(1))
def branch_paths(spark, sf):
    """All paths over blocks without repeats, from the entry to where a body ends."""
    _, edges, starts = _nodes(spark, sf)
    return _shown(recursion.bounded_walks(edges, starts, visits=1, limit=None))


@query(_walk_sql(2))
def branch_walks(spark, sf):
    """All walks over blocks that pass each at most twice, so loops are run through once more, to their end."""
    _, edges, starts = _nodes(spark, sf)
    return _shown(recursion.bounded_walks(edges, starts, visits=2, limit=None))


@query(
    _BEGIN + _BLOCKS + _NODES
    + """, fin AS (SELECT k.body * 100 + k.block AS src, k.body * 100 + 99 AS dst FROM blk k WHERE NOT EXISTS (SELECT 1 FROM be WHERE be.body = k.body AND be.block = k.block)),
    nx AS (SELECT * FROM node UNION ALL SELECT * FROM fin),
    calls AS (SELECT DISTINCT m.body * 100 + m.block AS src, CAST(c.callee AS BIGINT) * 10000 + 1 AS dst FROM num m JOIN code c ON c.body = m.body AND c.n = m.n WHERE c.op = 'CALL' AND CAST(c.callee AS BIGINT) * 100 IN (SELECT body FROM code)),
    w(path, stack, calls) AS (SELECT [body * 100 + 1], CAST([] AS BIGINT[]), 0 FROM (SELECT DISTINCT body FROM code) UNION ALL
      SELECT list_append(path, e.dst), e.stack, w.calls + e.n FROM w, LATERAL (
        SELECT nx.dst, w.stack, 0 AS n FROM nx WHERE nx.src = w.path[-1] AND (len(w.stack) >= 1 OR w.path[-1] NOT IN (SELECT src FROM calls))
        UNION ALL SELECT c.dst, list_append(w.stack, w.path[-1]), 1 FROM calls c WHERE c.src = w.path[-1] AND len(w.stack) < 1
        UNION ALL SELECT nx.dst, w.stack[:-2], 0 FROM nx WHERE w.path[-1] % 100 = 99 AND len(w.stack) > 0 AND nx.src = w.stack[-1]) e WHERE NOT list_contains(path, e.dst))
    SELECT path[1] // 100 AS method, array_to_string(path, '>') AS path, CAST(calls AS INT) AS calls FROM w WHERE path[-1] % 100 = 99 AND len(stack) = 0"""
)
def matched_paths(spark, sf):
    """Walks from each body's entry to its end through the bodies that it calls; a return leads back to its own call only."""
    rows, edges, starts = _nodes(spark, sf)
    blocks, _ = cfg.code_blocks(rows)
    blocks = blocks.select("method", "high", (F.col("method") * 100 + F.col("block")).alias("src"))
    ends = blocks.join(edges.select("src"), "src", "left_anti").select("src", (F.floor(F.col("src") / 100) * 100 + 99).alias("dst"))
    bodies = starts.select(F.col("node").alias("dst"))
    calls = rows.where("kind = 'CALL'").join(blocks.withColumnRenamed("high", "n"), ["method", "n"]).select("src", (F.col("callee").cast("long") * 10000 + 1).alias("dst")).join(bodies, "dst", "left_semi")
    found = recursion.matched_walks(edges.unionByName(ends), calls.select("src", "dst"), starts, max_calls=1)
    return found.select(F.floor(F.element_at("path", 1) / 100).cast("long").alias("method"), _text().alias("path"), "calls")
