"""Front-end relations on the test tables: dispatch, entry points, callbacks, component links, added call edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhead.operators import frontend, hierarchy
from trailhead.plans import binding as b
from trailhead.plans.graph_queries import _CLOSED, class_edges
from trailhead.plans.registry import query

_NAMED = f"""{_CLOSED}, names AS (SELECT sub AS class FROM class_edge UNION SELECT sup FROM class_edge), own(sub, sup, depth) AS (SELECT class, class, 0 FROM names UNION ALL SELECT sub, sup, MIN(depth) FROM up GROUP BY sub, sup),
  cm AS (SELECT class, 'm' || CAST(CAST(substr(class, 2) AS INT) % 3 AS VARCHAR) AS sub_sig FROM names)"""


def class_methods(spark, sf):
    """(class, sub_sig): one of three methods for each class of the hierarchy."""
    names = class_edges(spark, sf).select(F.explode(F.array("sub", "sup")).alias("class")).distinct()
    return names.select("class", F.concat(F.lit("m"), (F.substring("class", 2, 9).cast("int") % 3).cast("string")).alias("sub_sig"))


_CALL = {
    "call": "event_id",
    "class": "CASE event_id % 3 WHEN 0 THEN 'r' || CAST(event_id % 5 AS VARCHAR(9)) WHEN 1 THEN 'n' || CAST(event_id % 25 AS VARCHAR(9)) ELSE 'c' || CAST(event_id % 100 + 1 AS VARCHAR(9)) END",
    "sub_sig": "'m' || CAST(CAST(floor(event_id / 3) AS INT) % 3 AS VARCHAR(9))",
}
_CALLS = ", ".join(f"{v} AS {k}" for k, v in _CALL.items())


@query(
    f"""WITH RECURSIVE {_NAMED}, calls AS (SELECT {_CALLS} FROM events WHERE event_type = 'purchase'),
    best AS (SELECT o.sub AS actual, m.sub_sig, arg_min(o.sup, o.depth) AS target FROM own o JOIN cm m ON m.class = o.sup GROUP BY o.sub, m.sub_sig)
    SELECT DISTINCT c.call, c.sub_sig, t.target FROM calls c JOIN own o ON o.sup = c.class JOIN best t ON t.actual = o.sub AND t.sub_sig = c.sub_sig"""
)
def dispatch_targets(spark, sf):
    """Methods that a virtual call may run, over the classes at or below its declared one."""
    calls = b.table(spark, sf, "events").where("event_type = 'purchase'").selectExpr(*(f"{v} AS {k}" for k, v in _CALL.items()))
    return hierarchy.dispatch(calls, class_methods(spark, sf), class_edges(spark, sf))


@query(
    f"""WITH RECURSIVE {_NAMED}, pairs AS (SELECT DISTINCT 'c' || CAST(c_custkey AS VARCHAR) AS a, CASE c_custkey % 3 WHEN 0 THEN 'n' || CAST(c_nationkey AS VARCHAR) WHEN 1 THEN 'n' || CAST((c_nationkey + 1) % 25 AS VARCHAR) ELSE 'c' || CAST(c_custkey AS VARCHAR) END AS b FROM customer),
    both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs)
    SELECT a, b, CASE WHEN EXISTS (SELECT 1 FROM own WHERE sub = a AND sup = b) THEN a WHEN EXISTS (SELECT 1 FROM own WHERE sub = b AND sup = a) THEN b END AS precise FROM both_ways"""
)
def precise_types(spark, sf):
    """The lower one of two types, null where neither is below the other."""
    custom = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    nation = lambda c: F.concat(F.lit("n"), c.cast("string"))
    other = F.when(F.col("c_custkey") % 3 == 0, nation(F.col("c_nationkey"))).when(F.col("c_custkey") % 3 == 1, nation((F.col("c_nationkey") + 1) % 25)).otherwise(custom)
    pairs = b.table(spark, sf, "customer").select(custom.alias("a"), other.alias("b"))
    return hierarchy.more_precise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), class_edges(spark, sf))


# -- entry points

_KIND = "CASE c_nationkey % 5 WHEN 0 THEN 'Activity' WHEN 1 THEN 'Service' WHEN 2 THEN 'BroadcastReceiver' WHEN 3 THEN 'ContentProvider' ELSE 'Fragment' END"
_NAME = """CASE o_orderkey % 13 WHEN 0 THEN 'onCreate' WHEN 1 THEN 'onStart' WHEN 2 THEN 'onResume' WHEN 3 THEN 'onPause' WHEN 4 THEN 'onStop' WHEN 5 THEN 'onDestroy' WHEN 6 THEN 'onReceive' WHEN 7 THEN 'query' WHEN 8 THEN 'insert'
  WHEN 9 THEN 'onBind' WHEN 10 THEN 'onAttach' WHEN 11 THEN 'onCreateView' ELSE 'helper' END"""
_ENTRIES = f"""steps(component, name, step) AS (VALUES ('Activity', 'onCreate', 0), ('Activity', 'onStart', 1), ('Activity', 'onResume', 4), ('Activity', 'onPause', 6), ('Activity', 'onStop', 8), ('Activity', 'onDestroy', 10),
  ('Service', 'onCreate', 0), ('Service', 'onStart', 1), ('Service', 'onBind', 3), ('Service', 'onDestroy', 6), ('BroadcastReceiver', 'onReceive', 0), ('ContentProvider', 'onCreate', 0), ('ContentProvider', 'insert', 1), ('ContentProvider', 'query', 2),
  ('Fragment', 'onAttach', 0), ('Fragment', 'onCreate', 1), ('Fragment', 'onCreateView', 2), ('Fragment', 'onStart', 4), ('Fragment', 'onResume', 5), ('Fragment', 'onPause', 6), ('Fragment', 'onStop', 7), ('Fragment', 'onDestroy', 9)),
  entries AS (SELECT c.class, c.component, m.class || '.' || m.name AS method, s.step FROM (SELECT DISTINCT 'c' || CAST(c_custkey AS VARCHAR) AS class, {_KIND} AS component FROM customer) c
  JOIN (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS class, {_NAME} AS name FROM orders) m ON m.class = c.class JOIN steps s ON s.component = c.component AND s.name = m.name)"""


def _entries(spark, sf):
    components = b.table(spark, sf, "customer").selectExpr("'c' || CAST(c_custkey AS STRING) AS class", f"{_KIND} AS component").distinct()
    methods = b.table(spark, sf, "orders").selectExpr("'c' || CAST(o_custkey AS STRING) AS class", f"{_NAME} AS name").distinct()
    return frontend.entry_points(components, methods.withColumn("sig", F.concat_ws(".", "class", "name")))


@query(f"WITH {_ENTRIES} SELECT class, component, method, step FROM entries")
def entry_point_methods(spark, sf):
    """Lifecycle methods of each component in the order in which they run."""
    return _entries(spark, sf)


@query(f"WITH {_ENTRIES} SELECT DISTINCT 'dummyMain' AS src, 'dummyMain_' || class AS dst FROM entries UNION ALL SELECT 'dummyMain_' || class, method FROM entries")
def dummy_main_edges(spark, sf):
    """Calls of the synthetic main methods."""
    return frontend.dummy_edges(_entries(spark, sf))


# -- callbacks


@query(
    f"""WITH RECURSIVE {_NAMED}, wanted(name, sub_sig) AS (VALUES ('r1', 'm1'), ('n3', 'm0'), ('n7', 'm2'), ('r2', 'm0'))
    SELECT DISTINCT 'k' || CAST(o_custkey % 10 AS VARCHAR) AS component, m.class || '.' || m.sub_sig AS method FROM orders JOIN own o ON o.sub = 'c' || CAST(o_custkey AS VARCHAR) JOIN wanted w ON w.name = o.sup JOIN cm m ON m.class = o.sub AND m.sub_sig = w.sub_sig"""
)
def callback_registrations(spark, sf):
    """Callbacks of objects that are passed where an interface of the list is wanted."""
    invokes = b.table(spark, sf, "orders").selectExpr("'k' || CAST(o_custkey % 10 AS STRING) AS component", "'c' || CAST(o_custkey AS STRING) AS arg_class").distinct()
    wanted = spark.createDataFrame([("r1", "m1"), ("n3", "m0"), ("n7", "m2"), ("r2", "m0")], "name string, sub_sig string")
    return frontend.registered_callbacks(invokes, wanted, class_methods(spark, sf).withColumn("sig", F.concat_ws(".", "class", "sub_sig")), class_edges(spark, sf))


@query(
    f"""WITH RECURSIVE {_NAMED} SELECT DISTINCT c.class AS component, c.class || '.' || m.sub_sig AS method FROM (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS class FROM customer WHERE c_acctbal > 0) c JOIN cm m ON m.class = c.class
    JOIN up ON up.sub = c.class JOIN cm z ON z.class = up.sup AND z.sub_sig = m.sub_sig WHERE up.sup IN ('r0', 'r2', 'n4', 'n8')"""
)
def callback_overrides(spark, sf):
    """Methods of components that override one of a framework class."""
    components = b.table(spark, sf, "customer").where("c_acctbal > 0").selectExpr("'c' || CAST(c_custkey AS STRING) AS class")
    framework = spark.createDataFrame([("r0",), ("r2",), ("n4",), ("n8",)], "class string")
    return frontend.overriding_callbacks(components, class_methods(spark, sf).withColumn("sig", F.concat_ws(".", "class", "sub_sig")), class_edges(spark, sf), framework)


@query(
    b.with_sql("edge", "method", recursive=True)[:-1]
    + """, reg AS (SELECT p_partkey AS method, CAST(floor(p_partkey / 2) AS BIGINT) + 1 AS callback FROM part WHERE p_size <= 5), every AS (SELECT src, dst FROM edge UNION SELECT method, callback FROM reg),
    seen(component, node) AS (SELECT DISTINCT 'k' || CAST(method_id % 40 AS VARCHAR), method_id FROM method WHERE size > 40 AND method_id % 7 = 0 UNION SELECT s.component, e.dst FROM seen s JOIN every e ON e.src = s.node),
    many AS (SELECT component FROM seen WHERE node IN (SELECT callback FROM reg) GROUP BY component HAVING COUNT(*) > 15)
    SELECT component, node AS method FROM seen WHERE component NOT IN (SELECT component FROM many)"""
)
def component_callbacks(spark, sf):
    """Methods of each component with the callbacks that those in reach register; components with more than fifteen of them are left out."""
    methods = b.methods(spark, sf).where("size > 40 AND method_id % 7 = 0").selectExpr("'k' || CAST(method_id % 40 AS STRING) AS class", "method_id AS method")
    registrations = b.table(spark, sf, "part").where("p_size <= 5").selectExpr("p_partkey AS method", "CAST(floor(p_partkey / 2) AS BIGINT) + 1 AS callback")
    return frontend.discovered(methods.select("class").distinct(), methods, b.edges(spark, sf), registrations, cap=15)


_HANDLERS = """'h' || CAST(p_partkey AS VARCHAR(9)) AS class, CASE p_partkey % 6 WHEN 0 THEN 'Fragment' WHEN 1 THEN 'Activity' WHEN 2 THEN 'Application' ELSE 'Plain' END AS kind, p_partkey % 6 IN (1, 2) AS is_component,
  p_size % 4 AS nested, p_size % 3 = 0 AS listens, p_size % 5 <> 0 AS constructed, p_partkey AS k"""


@query(
    f"""WITH cls AS (SELECT {_HANDLERS} FROM part),
    cb AS (SELECT DISTINCT 'h' || CAST(l_partkey AS VARCHAR) AS component, 'h' || CAST(l_partkey + l_linenumber - 4 AS VARCHAR) AS class, CASE l_returnflag WHEN 'A' THEN 'onLowMemory' ELSE 'onClick' END AS name, l_returnflag = 'A' AS of_application
      FROM lineitem WHERE l_partkey % 6 IN (1, 2)),
    j AS (SELECT cb.*, h.kind AS host, c.kind, c.is_component, c.listens, c.constructed, c.k, CASE c.nested WHEN 1 THEN c.k - 1 WHEN 2 THEN c.k + 1 END AS outer_k, CASE WHEN c.nested = 3 THEN c.k + 1 END AS need_k, h.k AS hk FROM cb JOIN cls h ON h.class = cb.component JOIN cls c ON c.class = cb.class)
    SELECT DISTINCT component, class, name FROM j WHERE (kind <> 'Fragment' OR host = 'Activity' AND hk = k + 1) AND (hk = k OR NOT is_component) AND (host <> 'Application' OR hk = k OR listens)
    AND (constructed OR kind = 'Fragment' OR hk = k OR outer_k IS NOT DISTINCT FROM hk) AND (outer_k IS NULL OR outer_k = hk OR NOT EXISTS (SELECT 1 FROM cls o WHERE o.k = outer_k AND o.is_component))
    AND (need_k IS NULL OR need_k = hk OR NOT EXISTS (SELECT 1 FROM cls n WHERE n.k = need_k AND n.is_component)) AND (host = 'Application' OR NOT of_application)"""
)
def filtered_callbacks(spark, sf):
    """Callbacks that the filters on hosts, fragments, applications and constructors leave."""
    other = lambda k, when: F.when(F.col("nested") == when, F.array(F.concat(F.lit("h"), (F.col("k") + k).cast("string"))))
    none = F.array().cast("array<string>")
    parts = b.table(spark, sf, "part").select("p_partkey", "p_size").selectExpr(
        "'h' || CAST(p_partkey AS STRING) AS class", "CASE p_partkey % 6 WHEN 0 THEN 'Fragment' WHEN 1 THEN 'Activity' WHEN 2 THEN 'Application' ELSE 'Plain' END AS kind", "p_partkey % 6 IN (1, 2) AS is_component",
        "p_size % 4 AS nested", "p_size % 3 = 0 AS listens", "p_size % 5 <> 0 AS constructed", "p_partkey AS k",
    )
    classes = parts.select("class", "kind", "is_component", F.coalesce(other(-1, 1), other(1, 2), none).alias("outers"), F.coalesce(other(1, 3), none).alias("needs"), "listens", "constructed")
    rows = b.table(spark, sf, "lineitem").where("l_partkey % 6 IN (1, 2)").selectExpr(
        "'h' || CAST(l_partkey AS STRING) AS component", "'h' || CAST(l_partkey + l_linenumber - 4 AS STRING) AS class", "CASE l_returnflag WHEN 'A' THEN 'onLowMemory' ELSE 'onClick' END AS name", "l_returnflag = 'A' AS of_application"
    )
    fragments = parts.where("kind = 'Fragment'").selectExpr("class AS fragment", "'h' || CAST(k + 1 AS STRING) AS activity")
    return frontend.own_callbacks(rows.distinct(), classes, fragments, classes.select(F.col("class").alias("sub"), F.col("class").alias("sup")))


# -- component links, added edges, layouts


@query(
    """WITH sends AS (SELECT event_id AS stmt, 'k' || CAST(user_id AS VARCHAR) AS src, 'p' || CAST(user_id % 5 AS VARCHAR) AS package, CASE WHEN event_id % 3 = 0 THEN 'c' || CAST(event_id % 300 AS VARCHAR) END AS target, 'a' || CAST(event_id % 40 AS VARCHAR) AS action FROM events),
    comp AS (SELECT DISTINCT 'c' || CAST(c_custkey AS VARCHAR) AS name, 'p' || CAST(c_nationkey % 5 AS VARCHAR) AS package, c_acctbal > 5000 AS exported, c_custkey, c_nationkey FROM customer),
    offer AS (SELECT name, package, exported, 'a' || CAST(c_custkey % 40 AS VARCHAR) AS action FROM comp UNION SELECT name, package, exported, 'a' || CAST(c_nationkey AS VARCHAR) FROM comp)
    SELECT DISTINCT s.stmt, s.src, c.name AS dst FROM sends s JOIN comp c ON c.name = s.target
    UNION SELECT s.stmt, s.src, o.name FROM sends s JOIN offer o ON o.action = s.action WHERE s.target IS NULL AND (o.exported OR o.package = s.package)"""
)
def component_link_pairs(spark, sf):
    """Components that intents lead to, by target or by action."""
    sends = b.table(spark, sf, "events").selectExpr("event_id AS stmt", "'k' || CAST(user_id AS STRING) AS src", "'p' || CAST(user_id % 5 AS STRING) AS package", "CASE WHEN event_id % 3 = 0 THEN 'c' || CAST(event_id % 300 AS STRING) END AS target", "'a' || CAST(event_id % 40 AS STRING) AS action")
    components = b.table(spark, sf, "customer").selectExpr("'c' || CAST(c_custkey AS STRING) AS name", "'p' || CAST(c_nationkey % 5 AS STRING) AS package", "c_acctbal > 5000 AS exported", "array('a' || CAST(c_custkey % 40 AS STRING), 'a' || CAST(c_nationkey AS STRING)) AS actions")
    return frontend.component_links(sends, components)


_ACCESS = "'m' || CAST(src AS VARCHAR(9)) AS src, 'C' || CAST(dst AS VARCHAR(9)) || CASE WHEN dst % 4 = 0 THEN '$$Nest$m' ELSE '.' END || 'get' AS dst"


@query(b.with_sql("edge")[:-1] + f", e AS (SELECT {_ACCESS} FROM edge) SELECT src, dst FROM e UNION SELECT src, replace(dst, '$$Nest$m', '') FROM e")
def accessor_calls(spark, sf):
    """Calls with those that synthetic accessors stand for."""
    return frontend.accessor_edges(b.edges(spark, sf).selectExpr("'m' || CAST(src AS STRING) AS src", "'C' || CAST(dst AS STRING) || CASE WHEN dst % 4 = 0 THEN '$$Nest$m' ELSE '.' END || 'get' AS dst"))


@query(
    b.with_sql("edge", "method")[:-1]
    + """, reg AS (SELECT DISTINCT user_id AS method, 'com.' || lower(event_type) AS listener_class FROM events), h AS (SELECT method_id, 'com.' || CASE size % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'signup' END AS class, CASE WHEN size % 5 = 0 THEN 'lambda$x' ELSE name END AS name FROM method)
    SELECT src, dst FROM edge UNION SELECT r.method, h.method_id FROM reg r JOIN h ON h.class = r.listener_class WHERE h.name LIKE 'onClick%' OR h.name LIKE 'lambda$%'"""
)
def listener_calls(spark, sf):
    """Calls with those from a registering method to its listener's handlers."""
    registrations = b.table(spark, sf, "events").selectExpr("user_id AS method", "'com.' || lower(event_type) AS listener_class").distinct()
    handlers = b.methods(spark, sf).selectExpr("method_id AS sig", "'com.' || CASE size % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'signup' END AS class", "CASE WHEN size % 5 = 0 THEN 'lambda$x' ELSE name END AS name")
    return frontend.listener_edges(b.edges(spark, sf), registrations, handlers)


@query("SELECT CAST(user_id AS VARCHAR) AS method, event_id AS stmt, user_id * 100 + event_id % 100 AS control_id FROM events WHERE user_id * 100 + event_id % 100 IN (SELECT p_partkey FROM part WHERE p_size % 7 = 0)")
def sensitive_controls(spark, sf):
    """Lookups of controls that take passwords."""
    lookups = b.table(spark, sf, "events").selectExpr("CAST(user_id AS STRING) AS method", "event_id AS stmt", "user_id * 100 + event_id % 100 AS control_id")
    controls = b.table(spark, sf, "part").selectExpr("p_partkey AS id", "p_type AS view", "p_size % 7 = 0 AS sensitive")
    return frontend.control_sources(lookups, controls)


@query(
    """WITH c AS (SELECT event_id AS call, event_id % 4 AS k FROM events) SELECT call, CAST(0 AS INT) AS step, 'new' AS kind, CAST(NULL AS VARCHAR) AS value FROM c UNION ALL SELECT call, CAST(CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 4 END AS INT), 'text', NULL FROM c
    UNION ALL SELECT call, 1, 'append', 'a' || CAST(call AS VARCHAR) FROM c WHERE k = 1 UNION ALL SELECT call, 2, 'append_constant', 'x=' FROM c WHERE k = 1
    UNION ALL SELECT call, 1, 'append_constant', 'id ' FROM c WHERE k = 2 UNION ALL SELECT call, 2, 'append', 'a' || CAST(call AS VARCHAR) FROM c WHERE k = 2 UNION ALL SELECT call, 3, 'append', 'b' FROM c WHERE k = 2 UNION ALL SELECT call, 4, 'append_constant', ';' FROM c WHERE k = 2
    UNION ALL SELECT call, 1, 'append_constant', 'k0' FROM c WHERE k = 3 UNION ALL SELECT call, 2, 'append', 'a' || CAST(call AS VARCHAR) FROM c WHERE k = 3 UNION ALL SELECT call, 3, 'append_constant', 'k1' FROM c WHERE k = 3"""
)
def concatenation_steps(spark, sf):
    """Builder calls for recipes with text, arguments and constants in turn."""
    recipe = "element_at(array('', '\\u0001x=', 'id \\u0001\\u0001;', '\\u0002\\u0001\\u0002'), CAST(event_id % 4 AS INT) + 1)"
    calls = b.table(spark, sf, "events").selectExpr("event_id AS call", f"{recipe} AS recipe", "array('a' || CAST(event_id AS STRING), 'b') AS args", "array('k0', 'k1') AS constants")
    return frontend.concatenations(calls)


# -- further kinds of components, the order of their methods, and library methods that run what they are given

_MORE = "CASE o_orderkey % 4 WHEN 0 THEN 'Application' WHEN 1 THEN 'ServiceConnection' WHEN 2 THEN 'HostApduService' ELSE 'ComponentCallbacks' END"
_MORE_NAME = "CASE o_custkey % 7 WHEN 0 THEN 'onCreate' WHEN 1 THEN 'onTerminate' WHEN 2 THEN 'onServiceDisconnected' WHEN 3 THEN 'processCommandApdu' WHEN 4 THEN 'onDeactivated' WHEN 5 THEN 'onLowMemory' ELSE 'helper' END"


@query(
    f"""WITH m AS (SELECT 'o' || CAST(o_orderkey % 500 AS VARCHAR) AS class, {_MORE_NAME} AS name, {_MORE} AS component FROM orders), steps(component, name, step) AS (VALUES ('Application', 'onCreate', 0), ('Application', 'onTerminate', 1), ('ServiceConnection', 'onServiceDisconnected', 1),
    ('HostApduService', 'processCommandApdu', 0), ('HostApduService', 'onDeactivated', 1), ('ComponentCallbacks', 'onLowMemory', 0)) SELECT DISTINCT class, component, class || '.' || name AS method, step FROM m JOIN steps USING (component, name)"""
)
def further_entry_points(spark, sf):
    """Lifecycle methods of applications, connections and services of cards, and callbacks of all components."""
    rows = b.table(spark, sf, "orders").selectExpr("'o' || CAST(o_orderkey % 500 AS STRING) AS class", f"{_MORE_NAME} AS name", f"{_MORE} AS component")
    methods = rows.select("class", "name").distinct().withColumn("sig", F.concat_ws(".", "class", "name"))
    return frontend.entry_points(rows.select("class", "component").distinct(), methods)


@query(
    f"""WITH {_ENTRIES}, n AS (SELECT DISTINCT 'dummyMain_' || class AS method, CAST(step + 1 AS BIGINT) AS node FROM entries)
    SELECT method, true AS sequential, CAST(0 AS BIGINT) AS src, MIN(node) AS dst FROM n GROUP BY method UNION ALL SELECT method, true, node, COALESCE(LEAD(node) OVER (PARTITION BY method ORDER BY node), -1) FROM n
    UNION ALL SELECT method, false, 0, node FROM n UNION ALL SELECT method, false, node, 0 FROM n UNION ALL SELECT DISTINCT method, false, 0, -1 FROM n"""
)
def dummy_control_flow(spark, sf):
    """Control flow of the synthetic methods: lifecycle methods in their order, and in any."""
    entries = _entries(spark, sf)
    flow = lambda sequential: frontend.dummy_flow(entries, sequential).withColumn("sequential", F.lit(sequential))
    return flow(True).unionByName(flow(False))


_RUNS = "CASE event_id % 4 WHEN 0 THEN '<java.lang.Thread: void start()>' WHEN 1 THEN '<android.os.Handler: boolean post(java.lang.Runnable)>' WHEN 2 THEN '<android.os.Handler: boolean sendMessage(android.os.Message)>' ELSE '<a.B: void other()>' END"
_GIVEN = _CALL["class"].replace("event_id", "(event_id + 1)")
_SUB = "CASE sub_sig WHEN 'm0' THEN 'void run()' WHEN 'm1' THEN 'void handleMessage(android.os.Message)' ELSE sub_sig END"


@query(
    f"""WITH RECURSIVE {_NAMED}, calls AS (SELECT event_id AS call, {_RUNS} AS callee, {_CALL["class"]} AS receiver, {_GIVEN} AS given FROM events WHERE event_type = 'purchase'),
    patched AS (SELECT call, CASE event_id_kind WHEN 1 THEN given ELSE receiver END AS class, CASE event_id_kind WHEN 2 THEN 'void handleMessage(android.os.Message)' ELSE 'void run()' END AS sub_sig FROM (SELECT *, CASE callee WHEN '<java.lang.Thread: void start()>' THEN 0 WHEN '<android.os.Handler: boolean post(java.lang.Runnable)>' THEN 1 WHEN '<android.os.Handler: boolean sendMessage(android.os.Message)>' THEN 2 END AS event_id_kind FROM calls) x WHERE event_id_kind IS NOT NULL),
    named AS (SELECT class, {_SUB} AS sub_sig, * EXCLUDE (class, sub_sig) FROM cm),
    best AS (SELECT o.sub AS actual, m.sub_sig, arg_min(o.sup, o.depth) AS target FROM own o JOIN named m ON m.class = o.sup GROUP BY o.sub, m.sub_sig)
    SELECT DISTINCT c.call, c.sub_sig, t.target FROM patched c JOIN own o ON o.sup = c.class JOIN best t ON t.actual = o.sub AND t.sub_sig = c.sub_sig"""
)
def patched_library_calls(spark, sf):
    """What threads, handlers and timers run of the objects that they are given."""
    calls = b.table(spark, sf, "events").where("event_type = 'purchase'").selectExpr("event_id AS call", f"{_RUNS} AS callee", f"array({_CALL['class']}, {_GIVEN}) AS classes")
    return frontend.patched_calls(calls, class_methods(spark, sf).withColumn("sub_sig", F.expr(_SUB)), class_edges(spark, sf))
