"""Library models, wrappers, definitions, aliases and containers on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhead.config import CategoryMode
from trailhead.operators import collections, hierarchy, plugins, summaries
from trailhead.plans import binding as b
from trailhead.plans.front_queries import _CALL, _CALLS, _NAMED
from trailhead.plans.graph_queries import class_edges
from trailhead.plans.registry import query

# -- resolution of summaries

_FLOWS = """flows AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS class, 'm' || CAST(n_nationkey % 3 AS VARCHAR) AS method, 'f' || CAST(n_nationkey AS VARCHAR) AS flow FROM nation
  UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'm' || CAST(r_regionkey % 2 AS VARCHAR), 'g' || CAST(r_regionkey AS VARCHAR) FROM region)"""


def _calls(spark, sf):
    return b.table(spark, sf, "events").where("event_type = 'purchase'").selectExpr(*(f"{v} AS {k}" for k, v in _CALL.items())).withColumnRenamed("sub_sig", "method")


def _flows(spark, sf):
    nation = b.table(spark, sf, "nation").selectExpr("'n' || CAST(n_nationkey AS STRING) AS class", "'m' || CAST(n_nationkey % 3 AS STRING) AS method", "'f' || CAST(n_nationkey AS STRING) AS flow")
    return nation.unionByName(b.table(spark, sf, "region").selectExpr("'r' || CAST(r_regionkey AS STRING) AS class", "'m' || CAST(r_regionkey % 2 AS STRING) AS method", "'g' || CAST(r_regionkey AS STRING) AS flow"))


@query(
    f"""WITH RECURSIVE {_NAMED}, {_FLOWS}, calls AS (SELECT {_CALLS} FROM events WHERE event_type = 'purchase'),
    above AS (SELECT c.call, o.sup AS owner, o.depth FROM calls c JOIN own o ON o.sub = c.class WHERE EXISTS (SELECT 1 FROM flows f WHERE f.class = o.sup AND f.method = c.sub_sig)),
    below AS (SELECT c.call, o.sub AS owner FROM calls c JOIN own o ON o.sup = c.class AND o.depth > 0 WHERE c.call NOT IN (SELECT call FROM above) AND EXISTS (SELECT 1 FROM flows f WHERE f.class = o.sub AND f.method = c.sub_sig)),
    chosen AS (SELECT call, arg_min(owner, depth) AS owner FROM above GROUP BY call UNION ALL SELECT call, owner FROM below)
    SELECT h.call, h.owner, f.method, f.flow FROM chosen h JOIN calls c ON c.call = h.call JOIN flows f ON f.class = h.owner AND f.method = c.sub_sig"""
)
def summary_resolution(spark, sf):
    """Flows that a call takes: of its class, of the nearest one above, or of all below."""
    return summaries.resolved(_calls(spark, sf), _flows(spark, sf), class_edges(spark, sf)).select("call", "owner", "method", "flow")


@query(f"WITH {_FLOWS}, calls AS (SELECT {_CALLS} FROM events WHERE event_type = 'purchase') SELECT class, sub_sig AS method, COUNT(*) AS n FROM calls c WHERE NOT EXISTS (SELECT 1 FROM flows f WHERE f.class = c.class AND f.method = c.sub_sig) GROUP BY class, sub_sig")
def missing_summaries(spark, sf):
    """Called methods that no summary covers."""
    return summaries.missing(_calls(spark, sf), _flows(spark, sf))


@query(f"WITH {_FLOWS}, calls AS (SELECT {_CALLS} FROM events WHERE event_type = 'purchase') SELECT class AS callee, COUNT(*) FILTER (hit) AS hits, COUNT(*) FILTER (NOT hit) AS misses FROM (SELECT c.class, EXISTS (SELECT 1 FROM flows f WHERE f.class = c.class AND f.method = c.sub_sig) AS hit FROM calls c) t GROUP BY class")
def wrapper_counters(spark, sf):
    """How often a wrapper knew the calls of each class."""
    calls = _calls(spark, sf)
    return plugins.recorded(calls.join(_flows(spark, sf), ["class", "method"]), calls.withColumnRenamed("class", "callee"))


# -- application

_KINDS = "CASE {0} % 3 WHEN 0 THEN 'param' WHEN 1 THEN 'field' ELSE 'return' END"
_PATH = "CASE {0} % 4 WHEN 0 THEN {1} WHEN 1 THEN {2} WHEN 2 THEN {3} ELSE {4} END"


def _paths(of, dialect):
    lists = ["CAST([] AS VARCHAR[])", "['f1']", "['f1', 'f2']", "['f3']"] if dialect == "duckdb" else ["CAST(array() AS ARRAY<STRING>)", "array('f1')", "array('f1', 'f2')", "array('f3')"]
    return _PATH.format(of, *lists)


def _ends(dialect):
    """Columns of the taints before a call and of its flows, from line items."""
    k = _KINDS.format
    return (
        f"l_orderkey AS call, {k('l_linenumber')} AS kind, CAST(l_linenumber % 2 AS INT) AS param, {_paths('l_partkey', dialect)} AS fields, {k('l_partkey')} AS from_kind, CAST(l_suppkey % 2 AS INT) AS from_param, {_paths('l_suppkey', dialect)} AS from_fields, "
        f"l_linenumber % 5 = 0 AS strict, {k('l_suppkey')} AS to_kind, CAST(l_partkey % 2 AS INT) AS to_param, {_paths('l_linenumber', dialect)} AS to_fields, l_returnflag AS flag"
    )


@query(
    f"""WITH x AS (SELECT {_ends("duckdb")} FROM lineitem), taints AS (SELECT DISTINCT call, kind, param, fields FROM x WHERE flag <> 'R'), flows AS (SELECT * FROM x WHERE flag <> 'A'), clears AS (SELECT * FROM x WHERE flag = 'A'),
    made AS (SELECT t.call, f.to_kind AS kind, f.to_param AS param, CASE WHEN len(t.fields) >= len(f.from_fields) AND t.fields[1:len(f.from_fields)] = f.from_fields THEN list_concat(f.to_fields, t.fields[len(f.from_fields) + 1:])
      WHEN NOT f.strict AND f.from_fields[1:len(t.fields)] = t.fields THEN f.to_fields END[1:5] AS fields FROM taints t JOIN flows f ON f.call = t.call AND f.from_kind = t.kind AND f.from_param = t.param),
    stay AS (SELECT * FROM taints t WHERE NOT EXISTS (SELECT 1 FROM clears c WHERE c.call = t.call AND c.from_kind = t.kind AND c.from_param = t.param AND len(t.fields) >= len(c.from_fields) AND t.fields[1:len(c.from_fields)] = c.from_fields))
    SELECT call, kind, param, array_to_string(fields, '.') AS fields FROM made WHERE fields IS NOT NULL UNION SELECT call, kind, param, array_to_string(fields, '.') FROM stay"""
)
def summary_application(spark, sf):
    """Taints after calls by their flows and clears, with access paths."""
    rows = b.table(spark, sf, "lineitem").selectExpr(*_split(_ends("spark")))
    start = F.struct(F.col("from_kind").alias("kind"), F.col("from_param").alias("param"), F.col("from_fields").alias("fields"), F.col("strict").alias("match_strict"))
    end = F.struct(F.col("to_kind").alias("kind"), F.col("to_param").alias("param"), F.col("to_fields").alias("fields"))
    flows = rows.where("flag <> 'A'").select("call", start.alias("from"), end.alias("to"))
    clears = rows.where("flag = 'A'").select("call", start.alias("clear"))
    made = summaries.applied(rows.where("flag <> 'R'").select("call", "kind", "param", "fields"), flows, clears)
    return made.select("call", "kind", "param", F.array_join("fields", ".").alias("fields")).distinct()


def _split(columns):
    """The columns of a list that has commas within brackets too."""
    found, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 0:
            found.append(columns[at:i])
            at = i + 1
    return [*found, columns[at:]]


# -- algebra

_MODEL = "'k' || CAST(o_custkey % 40 AS VARCHAR(9)) AS class, 'm' || CAST(o_orderkey % 3 AS VARCHAR(9)) AS method, 'p' || CAST(o_orderkey % 4 AS VARCHAR(9)) AS src, 'p' || CAST(o_custkey % 4 AS VARCHAR(9)) AS dst, o_orderkey % 5 = 0 AS is_alias"


@query(f"WITH f AS (SELECT DISTINCT {_MODEL} FROM orders) SELECT class, method, src, dst FROM f WHERE is_alias UNION SELECT class, method, dst, src FROM f WHERE is_alias")
def alias_flows(spark, sf):
    """Alias flows of summaries, both ways."""
    rows = b.table(spark, sf, "orders").selectExpr(*_split(_MODEL)).distinct().withColumnsRenamed({"src": "from", "dst": "to"})
    return summaries.aliases(rows).select("class", "method", F.col("from").alias("src"), F.col("to").alias("dst"))


@query(
    """WITH f AS (SELECT DISTINCT 'k' || CAST(o_custkey % 200 AS VARCHAR) AS class, 'm' AS method, o_orderkey % 3 AS fp, o_orderkey % 2 = 0 AS ff, o_custkey % 3 AS tp, o_orderstatus = 'O' AND o_custkey % 2 = 0 AS tf, o_orderkey % 7 < 3 AS is_alias FROM orders),
    g AS (SELECT *, fp * 10 + ff::INT AS a, tp * 10 + tf::INT AS b FROM f), precise AS (SELECT * FROM g x WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.class = x.class AND y.is_alias = x.is_alias AND (x.a <> y.a OR x.b <> y.b)
      AND x.fp = y.fp AND x.tp = y.tp AND (NOT x.ff OR y.ff) AND (NOT x.tf OR y.tf) AND NOT ((NOT y.ff OR x.ff) AND (NOT y.tf OR x.tf))))
    SELECT class, CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst, is_alias FROM precise x WHERE NOT (x.is_alias AND EXISTS (SELECT 1 FROM precise y WHERE y.class = x.class AND y.is_alias AND y.a = x.b AND y.b = x.a AND y.b < x.b))"""
)
def compacted_summaries(spark, sf):
    """Flows without those that a more precise one or a mirrored alias makes needless."""
    end = lambda p, f: F.struct(F.lit("param").alias("kind"), F.col(p).cast("int").alias("param"), F.when(F.col(f), F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")).alias("fields"))
    rows = b.table(spark, sf, "orders").selectExpr("'k' || CAST(o_custkey % 200 AS STRING) AS class", "'m' AS method", "o_orderkey % 3 AS fp", "o_orderkey % 2 = 0 AS ff", "o_custkey % 3 AS tp", "o_orderstatus = 'O' AND o_custkey % 2 = 0 AS tf", "o_orderkey % 7 < 3 AS is_alias")
    made = summaries.compacted(rows.select("class", "method", end("fp", "ff").alias("from"), end("tp", "tf").alias("to"), "is_alias"))
    place = lambda c: (F.col(c)["param"] * 10 + F.size(F.col(c)["fields"])).cast("long")
    return made.select("class", place("from").alias("src"), place("to").alias("dst"), "is_alias")


@query(
    "WITH f AS (SELECT 'k' || CAST(o_custkey % 100 AS VARCHAR) AS class, 'k' || CAST(o_orderkey % 150 AS VARCHAR) AS x, CASE WHEN o_orderkey % 4 > 0 THEN 'k' || CAST(o_orderkey % 170 AS VARCHAR) END AS y FROM orders), n AS (SELECT class, x AS needs FROM f UNION SELECT class, y FROM f WHERE y IS NOT NULL) "
    "SELECT class, needs FROM n WHERE needs NOT IN (SELECT class FROM f)"
)
def summary_dependencies(spark, sf):
    """Classes that summaries name without having one."""
    rows = b.table(spark, sf, "orders").selectExpr("'k' || CAST(o_custkey % 100 AS STRING) AS class", "named_struct('base_type', 'k' || CAST(o_orderkey % 150 AS STRING)) AS from", "named_struct('base_type', CASE WHEN o_orderkey % 4 > 0 THEN 'k' || CAST(o_orderkey % 170 AS STRING) END) AS to")
    return summaries.dependencies(rows)


_GAPS = """'m' || CAST(o_custkey % 50 AS VARCHAR(9)) AS method, 'p' || CAST(o_orderkey % 3 AS VARCHAR(9)) AS src, CASE WHEN o_orderkey % 3 > 0 THEN 'g' || CAST(o_orderkey % 5 AS VARCHAR(9)) END AS src_gap,
  'p' || CAST(o_custkey % 3 AS VARCHAR(9)) AS dst, CASE WHEN o_orderkey % 2 > 0 THEN 'g' || CAST(o_custkey % 5 AS VARCHAR(9)) END AS dst_gap"""
_BODIES = "'g' || CAST(n_nationkey % 5 AS VARCHAR(9)) AS gap, 'p' || CAST(n_regionkey % 3 AS VARCHAR(9)) AS src, 'p' || CAST(n_nationkey % 3 AS VARCHAR(9)) AS dst"


@query(
    f"""WITH RECURSIVE f AS (SELECT DISTINCT {_GAPS} FROM orders), g AS (SELECT DISTINCT {_BODIES} FROM nation WHERE n_nationkey % 2 = 0),
    inside(method, src, dst, gap) AS (SELECT method, src, dst, dst_gap FROM f WHERE src_gap IS NULL
      UNION SELECT a.method, a.src, f.dst, f.dst_gap FROM inside a JOIN g ON g.gap = a.gap AND g.src = a.dst JOIN f ON f.method = a.method AND f.src_gap = a.gap AND f.src = g.dst)
    SELECT DISTINCT method, src, dst FROM inside WHERE gap IS NULL"""
)
def summary_gaps(spark, sf):
    """Flows through library methods and the user code that they call back."""
    bodies = b.table(spark, sf, "nation").where("n_nationkey % 2 = 0").selectExpr(*_split(_BODIES))
    return summaries.through_gaps(b.table(spark, sf, "orders").selectExpr(*_split(_GAPS)), bodies)


# -- wrappers


@query(
    f"""WITH RECURSIVE {_NAMED}, calls AS (SELECT {_CALLS} FROM events WHERE event_type <> 'purchase'),
    rules AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'exclude' WHEN 1 THEN 'kill' ELSE 'propagate' END AS kind, n_nationkey % 3 AS rank, 'n' || CAST(n_nationkey AS VARCHAR) AS class, 'm' || CAST(n_regionkey % 3 AS VARCHAR) AS method FROM nation
      UNION ALL SELECT 'propagate', 2, 'r' || CAST(r_regionkey AS VARCHAR), 'm1' FROM region UNION ALL SELECT 'kill', 1, 'r' || CAST(r_regionkey AS VARCHAR), 'm1' FROM region WHERE r_regionkey % 2 = 0)
    SELECT c.call, arg_min(r.kind, o.depth * 3 + r.rank) AS action FROM calls c JOIN own o ON o.sub = c.class JOIN rules r ON r.class = o.sup AND r.method = c.sub_sig GROUP BY c.call"""
)
def wrapper_list_actions(spark, sf):
    """What a wrapper list does with calls; the nearest class decides."""
    nation = b.table(spark, sf, "nation").selectExpr("CASE n_nationkey % 3 WHEN 0 THEN 'exclude' WHEN 1 THEN 'kill' ELSE 'propagate' END AS kind", "'n' || CAST(n_nationkey AS STRING) AS class", "'m' || CAST(n_regionkey % 3 AS STRING) AS method")
    region = b.table(spark, sf, "region").selectExpr("'r' || CAST(r_regionkey AS STRING) AS class", "'m1' AS method", "r_regionkey % 2 = 0 AS even")
    rules = nation.unionByName(region.select(F.lit("propagate").alias("kind"), "class", "method")).unionByName(region.where("even").select(F.lit("kill").alias("kind"), "class", "method"))
    calls = b.table(spark, sf, "events").where("event_type <> 'purchase'").selectExpr(*(f"{v} AS {k}" for k, v in _CALL.items())).withColumnRenamed("sub_sig", "method")
    return summaries.listed(calls, rules, class_edges(spark, sf))


_IDENTITY = "event_id AS call, CASE WHEN event_id % 3 > 0 THEN 'v' || CAST(event_id % 4 AS VARCHAR(9)) END AS base, 'v' || CAST(user_id % 4 AS VARCHAR(9)) AS arg, CASE WHEN event_id % 5 > 0 THEN 'r' || CAST(event_id % 7 AS VARCHAR(9)) END AS result"


@query(f"WITH c AS (SELECT {_IDENTITY} FROM events), t AS (SELECT event_id AS call, 'v' || CAST(event_id % 2 AS VARCHAR) AS value FROM events WHERE event_id % 11 > 2) SELECT call, value FROM t UNION SELECT c.call, c.result FROM c JOIN t ON t.call = c.call WHERE result IS NOT NULL AND (COALESCE(base, '') = value OR arg = value)")
def identity_wrapper(spark, sf):
    """Taints after library calls that pass on what reaches them."""
    events = b.table(spark, sf, "events")
    calls = events.selectExpr(*_split(_IDENTITY)).withColumn("args", F.array("arg"))
    return summaries.identity(calls, events.where("event_id % 11 > 2").selectExpr("event_id AS call", "'v' || CAST(event_id % 2 AS STRING) AS value"))


_MODES = ("none", "default", "defaultfallback", "easy", "multi")


@query(
    """WITH s AS (SELECT event_id AS call, 's' || CAST(user_id AS VARCHAR) AS source, 'x' AS target FROM events WHERE event_id % 3 = 0), l AS (SELECT event_id AS call, 'l' || CAST(user_id AS VARCHAR) AS source, 'x' AS target FROM events WHERE event_id % 2 = 0)
    SELECT 'default' AS mode, * FROM s UNION ALL SELECT 'defaultfallback', * FROM s UNION ALL SELECT 'defaultfallback', * FROM l WHERE call NOT IN (SELECT call FROM s) UNION ALL SELECT 'easy', * FROM l UNION ALL SELECT 'multi', * FROM s UNION ALL SELECT 'multi', * FROM l"""
)
def wrapper_modes(spark, sf):
    """Effects of calls by each way to model libraries."""
    events = b.table(spark, sf, "events")
    given = events.where("event_id % 3 = 0").selectExpr("event_id AS call", "'s' || CAST(user_id AS STRING) AS source", "'x' AS target")
    by_list = events.where("event_id % 2 = 0").selectExpr("event_id AS call", "'l' || CAST(user_id AS STRING) AS source", "'x' AS target")
    found = None
    for mode in _MODES:
        made = summaries.modelled(mode, events.selectExpr("event_id AS call"), summaries=given, list=by_list).withColumn("mode", F.lit(mode))
        found = made if found is None else found.unionByName(made)
    return found


@query(
    """WITH c AS (SELECT event_id AS call, event_id % 4 AS k FROM events), t AS (SELECT event_id AS call, user_id % 4 AS arg FROM events WHERE event_id % 5 > 0)
    SELECT c.call, CASE k WHEN 0 THEN 'arg2' WHEN 1 THEN 'return' ELSE 'arg0' END AS place FROM c JOIN t ON t.call = c.call WHERE k = 0 AND arg = 0 OR k = 1 AND arg = 1 OR k = 2 AND arg = 3"""
)
def native_calls(spark, sf):
    """Places that native calls taint."""
    events = b.table(spark, sf, "events")
    calls = events.selectExpr("event_id AS call", "element_at(array('arraycopy', 'newArray', 'compareAndSwapObject', 'other'), CAST(event_id % 4 AS INT) + 1) AS name")
    return summaries.native(calls, events.selectExpr("event_id AS call", "'arg' || CAST(user_id % 4 AS STRING) AS place", "event_id % 5 > 0 AS active"))


# -- definitions


@query(
    """WITH d AS (SELECT p_partkey, p_size % 4 AS k FROM part) SELECT p_partkey, CASE mode WHEN 0 THEN 'all but' ELSE 'only' END AS mode FROM d, (VALUES (0), (1)) m(mode) WHERE CASE mode WHEN 0 THEN k NOT IN (0, 3) ELSE k IN (0, 3) END"""
)
def definitions_by_category(spark, sf):
    """Definitions under both category modes, one category being none at all."""
    rows = b.table(spark, sf, "part").selectExpr("p_partkey", "CASE p_size % 4 WHEN 0 THEN 'NETWORK' WHEN 1 THEN 'FILE' WHEN 2 THEN 'LOG' END AS category")
    made = {"all but": CategoryMode.USE_ALL_BUT_EXCLUDED, "only": CategoryMode.USE_ONLY_INCLUDED}
    left, right = (plugins.by_category(rows, mode, {"NETWORK", ""}).select("p_partkey", F.lit(name).alias("mode")) for name, mode in made.items())
    return left.unionByName(right)


@query(
    f"""WITH RECURSIVE {_NAMED}, calls AS (SELECT {_CALLS}, user_id AS method FROM events WHERE event_type = 'view'),
    defs AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS class, 'm' || CAST(n_nationkey % 3 AS VARCHAR) AS sub, 'N' || CAST(n_nationkey AS VARCHAR) AS category FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'm1', 'R' FROM region)
    SELECT CAST(c.method AS VARCHAR) AS method, c.call AS stmt, arg_min(d.category, o.depth) AS category FROM calls c JOIN own o ON o.sub = c.class JOIN defs d ON d.class = o.sup AND d.sub = c.sub_sig GROUP BY c.method, c.call"""
)
def definition_matches(spark, sf):
    """Calls that are sinks by a definition of their class or the nearest one above."""
    sig = lambda c, m: F.concat(F.lit("<"), F.col(c), F.lit(": "), m, F.lit(">"))
    nation = b.table(spark, sf, "nation").where("n_nationkey % 2 = 0").selectExpr("'n' || CAST(n_nationkey AS STRING) AS class", "'m' || CAST(n_nationkey % 3 AS STRING) AS m", "'N' || CAST(n_nationkey AS STRING) AS category")
    region = b.table(spark, sf, "region").selectExpr("'r' || CAST(r_regionkey AS STRING) AS class", "'m1' AS m", "'R' AS category")
    definitions = nation.unionByName(region).select(sig("class", F.col("m")).alias("sig"), "category", F.lit("arg").alias("position"), F.lit(0).alias("param_index"), F.lit(False).alias("is_source"), F.lit(True).alias("is_sink"))
    rows = b.table(spark, sf, "events").where("event_type = 'view'").selectExpr("user_id", *(f"{v} AS {k}" for k, v in _CALL.items()))
    stmts = rows.select(F.col("user_id").cast("string").alias("method"), F.col("call").alias("stmt"), sig("class", F.col("sub_sig")).alias("callee"))
    return plugins.ByDefinition(definitions, hierarchy.supertypes(class_edges(spark, sf))).sinks(stmts).select("method", "stmt", "category")


# -- aliases and containers


@query(
    b.with_sql("stmt", recursive=True)[:-1]
    + """, s AS (SELECT method, CAST(floor((ordinal - 1) / 8) AS BIGINT) AS block, CAST(ordinal AS BIGINT) AS n, 'v' || CAST(callee % 4 AS VARCHAR) AS lhs, CASE WHEN kind = 'ALLOCATION' OR callee % 3 = 0 THEN NULL ELSE 'v' || CAST(CAST(floor(callee / 4) AS INT) % 4 AS VARCHAR) END AS rhs, kind FROM stmt),
    d AS (SELECT * FROM s WHERE kind <> 'METHOD_CALL'), ask AS (SELECT method, block, n, 'v' || CAST(n % 4 AS VARCHAR) AS a, 'v' || CAST(CAST(floor(n / 4) AS INT) % 4 AS VARCHAR) AS b FROM s WHERE kind = 'METHOD_CALL'),
    walk(method, block, n, side, var, place, made) AS (SELECT method, block, n, 0, a, n, false FROM ask UNION ALL SELECT method, block, n, 1, b, n, false FROM ask
      UNION ALL SELECT w.method, w.block, w.n, w.side, COALESCE(d.rhs, CAST(d.n AS VARCHAR)), d.n, d.rhs IS NULL FROM walk w JOIN d ON d.method = w.method AND d.block = w.block AND NOT w.made AND d.lhs = w.var
        AND d.n = (SELECT MAX(e.n) FROM d e WHERE e.method = w.method AND e.block = w.block AND e.lhs = w.var AND e.n < w.place)),
    origin AS (SELECT method, block, n, side, arg_min(var, place) AS var FROM walk GROUP BY method, block, n, side)
    SELECT k.method, k.block, k.n AS ordinal, k.a, k.b, x.var = y.var AS must FROM ask k JOIN origin x ON x.method = k.method AND x.block = k.block AND x.n = k.n AND x.side = 0 JOIN origin y ON y.method = k.method AND y.block = k.block AND y.n = k.n AND y.side = 1"""
)
def must_alias_pairs(spark, sf):
    """Whether two variables surely hold the same object before a call."""
    var = lambda c: F.concat(F.lit("v"), c.cast("string"))
    rows = b.statements(spark, sf).withColumn("block", F.floor((F.col("ordinal") - 1) / 8)).withColumn("ordinal", F.col("ordinal").cast("long"))
    copied = F.when((F.col("kind") != "ALLOCATION") & (F.col("callee") % 3 != 0), var(F.floor(F.col("callee") / 4) % 4))
    stmts = rows.where("kind <> 'METHOD_CALL'").select("method", "block", "ordinal", var(F.col("callee") % 4).alias("lhs"), copied.alias("rhs"))
    asked = rows.where("kind = 'METHOD_CALL'").select("method", "block", "ordinal", var(F.col("ordinal") % 4).alias("a"), var(F.floor(F.col("ordinal") / 4) % 4).alias("b"))
    return collections.must_alias(stmts, asked)


_OPS = """method, 'x' || CAST(callee % 2 AS VARCHAR(9)) AS var, CAST(ordinal AS BIGINT) AS n, CASE kind WHEN 'ENTRY' THEN CASE WHEN callee % 9 = 0 THEN 'clear' ELSE 'set' END WHEN 'ALLOCATION' THEN 'add' WHEN 'SWITCH' THEN 'remove' ELSE 'get' END AS op,
  CAST(floor(callee / 2) AS INT) % 5 AS at, callee % 3 = 0 AS tainted"""


@query(
    b.with_sql("stmt", recursive=True)[:-1]
    + f""", o AS (SELECT *, row_number() OVER (PARTITION BY method, var ORDER BY n) AS i FROM (SELECT {_OPS} FROM stmt) t),
    run(method, var, i, places, leak) AS (SELECT method, var, CAST(0 AS BIGINT), CAST([] AS INT[]), false FROM (SELECT DISTINCT method, var FROM o) q
      UNION ALL SELECT r.method, r.var, o.i, CASE o.op WHEN 'clear' THEN [] WHEN 'add' THEN list_concat(list_transform(r.places, lambda p: CASE WHEN p >= o.at THEN p + 1 ELSE p END), CASE WHEN o.tainted THEN [o.at] ELSE [] END)
        WHEN 'set' THEN list_concat(list_filter(r.places, lambda p: p <> o.at), CASE WHEN o.tainted THEN [o.at] ELSE [] END)
        WHEN 'remove' THEN list_transform(list_filter(r.places, lambda p: p <> o.at), lambda p: CASE WHEN p > o.at THEN p - 1 ELSE p END) ELSE r.places END, list_contains(r.places, o.at)
      FROM run r JOIN o ON o.method = r.method AND o.var = r.var AND o.i = r.i + 1)
    SELECT o.method, o.var, o.n AS ordinal, r.leak FROM run r JOIN o ON o.method = r.method AND o.var = r.var AND o.i = r.i WHERE o.op = 'get'"""
)
def container_taint_lists(spark, sf):
    """Reads of lists that may give a tainted value, by exact positions."""
    return collections.list_reads(_ops(spark, sf))


def _ops(spark, sf):
    return b.statements(spark, sf).selectExpr(*_split(_OPS)).withColumnRenamed("n", "ordinal")


@query(
    b.with_sql("stmt")[:-1]
    + f""", o AS (SELECT * FROM (SELECT {_OPS} FROM stmt) t), g AS (SELECT * FROM o WHERE op = 'get'), w AS (SELECT g.method, g.var, g.n, MAX(o.n) FILTER (o.op = 'clear' OR o.at = g.at) AS last FROM g LEFT JOIN o ON o.method = g.method AND o.var = g.var AND o.n < g.n AND o.op <> 'get' GROUP BY g.method, g.var, g.n)
    SELECT w.method, w.var, w.n AS ordinal, COALESCE(o.op IN ('add', 'set') AND o.tainted, false) AS leak FROM w LEFT JOIN o ON o.method = w.method AND o.var = w.var AND o.n = w.last"""
)
def container_taint_maps(spark, sf):
    """Reads of maps that may give a tainted value, by constant keys."""
    return collections.map_reads(_ops(spark, sf))


@query(
    b.with_sql("stmt")[:-1]
    + f""", o AS (SELECT * FROM (SELECT {_OPS} FROM stmt) t), g AS (SELECT * FROM o WHERE op = 'get'), w AS (SELECT g.method, g.var, g.n, COALESCE(MAX(o.n) FILTER (o.op = 'clear'), 0) AS cleared, COALESCE(MAX(o.n) FILTER (o.op IN ('add', 'set') AND o.tainted), 0) AS put
      FROM g LEFT JOIN o ON o.method = g.method AND o.var = g.var AND o.n < g.n GROUP BY g.method, g.var, g.n) SELECT method, var, n AS ordinal, put > cleared AS leak FROM w"""
)
def container_taint_smashed(spark, sf):
    """Reads of lists that any tainted value taints as a whole."""
    return collections.list_reads(_ops(spark, sf), smash=True)
