"""Taint, side effects, aliasing, container contexts, exports and streams on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailhead.functions import containers as k
from trailhead.operators import cfg, frontend, recursion, stats, taint
from trailhead.plans import binding as b
from trailhead.plans.graph_queries import _FLOW
from trailhead.plans.registry import query
from trailhead.sources import writers
from trailhead.storage import shared_path
from trailhead.streaming import streams

_VAR = "'v' || CAST(callee % 5 AS VARCHAR(20))"
_RHS = "'v' || CAST(CAST(floor(callee / 5) AS INT) % 5 AS VARCHAR(20))"
_PROGRAM = f"prog AS (SELECT method, ordinal, kind, {_VAR} AS var, {_RHS} AS rhs FROM stmt)"


def program(spark, sf):
    """Statements of taint.STATEMENT: entries are sources, allocations copies, switches constants, calls sinks."""
    rows = b.statements(spark, sf).selectExpr("CAST(method AS STRING) AS method", "ordinal", "kind", f"{_VAR} AS var", f"{_RHS} AS other")
    none = F.lit(None).cast("string")
    kind = F.when(F.col("kind") == "ENTRY", "source").when(F.col("kind") == "METHOD_CALL", "sink").when(F.col("kind") == "IF_CONDITION", "nop").otherwise("assign")
    stmts = rows.select(
        "method", F.col("ordinal").cast("long").alias("stmt"), kind.alias("kind"), F.when(kind.isin("source", "assign"), F.col("var")).alias("lhs"), none.alias("lhs_field"),
        F.when(F.col("kind") == "ALLOCATION", F.col("other")).alias("rhs"), none.alias("rhs_field"), none.alias("callee"), none.alias("base"),
        F.when(kind == "sink", F.array("var")).otherwise(F.array().cast("array<string>")).alias("args"), none.alias("type"),
    )
    return stmts, cfg.flow_edges(b.statements(spark, sf)).withColumn("method", F.col("method").cast("string"))


@query(
    b.with_sql("stmt", recursive=True)[:-1] + ", " + _FLOW + ", " + _PROGRAM
    + """, fact(method, n, var, source) AS (SELECT p.method, f.dst, p.var, p.ordinal FROM prog p JOIN flow f ON f.method = p.method AND f.src = p.ordinal WHERE p.kind = 'ENTRY'
    UNION SELECT x.method, f.dst, CASE g.i WHEN 0 THEN x.var ELSE p.var END, x.source FROM fact x JOIN prog p ON p.method = x.method AND p.ordinal = x.n JOIN flow f ON f.method = x.method AND f.src = x.n
      CROSS JOIN (VALUES (0), (1)) g(i) WHERE (g.i = 0 AND NOT (p.kind IN ('ENTRY', 'ALLOCATION', 'SWITCH') AND p.var = x.var)) OR (g.i = 1 AND p.kind = 'ALLOCATION' AND p.rhs = x.var))
    SELECT DISTINCT CAST(x.method AS VARCHAR) AS method, CAST(x.n AS BIGINT) AS sink, CAST(x.source AS BIGINT) AS source, x.var AS fact FROM fact x JOIN prog p ON p.method = x.method AND p.ordinal = x.n WHERE p.kind = 'METHOD_CALL' AND p.var = x.var"""
)
def taint_flows(spark, sf):
    """Sources that reach sinks through copies, constants and branches."""
    stmts, edges = program(spark, sf)
    roots = stmts.select("method").distinct()
    return taint.flows(stmts, edges, spark.createDataFrame([], "method string, names array<string>"), roots)


@query(
    b.with_sql("edge_cyc", "method", recursive=True)[:-1]
    + ", r(node) AS (SELECT method_id FROM method WHERE name = 'query' UNION SELECT e.src FROM r JOIN edge_cyc e ON e.dst = r.node) SELECT node AS method FROM r"
)
def side_effect_methods(spark, sf):
    direct = b.methods(spark, sf).where("name = 'query'").select(F.col("method_id").alias("method"))
    return frontend.side_effects(b.edges_cyc(spark, sf), direct)


@query(
    b.with_sql("edge", "method", recursive=True)[:-1]
    + ", u(method, field) AS (SELECT method_id, category FROM method WHERE dangerous UNION SELECT e.src, u.field FROM u JOIN edge e ON e.dst = u.method) SELECT method, field FROM u"
)
def static_field_uses(spark, sf):
    """Static fields (one for each category) that methods use themselves or through calls."""
    uses = b.methods(spark, sf).where("dangerous").select(F.col("method_id").alias("method"), F.col("category").alias("field"))
    return frontend.static_uses(b.edges(spark, sf), uses)


@query("SELECT DISTINCT x.l_suppkey AS method, x.l_linenumber AS a, y.l_linenumber AS b FROM lineitem x JOIN lineitem y ON x.l_suppkey = y.l_suppkey AND x.l_partkey = y.l_partkey AND x.l_linenumber < y.l_linenumber")
def may_alias_pairs(spark, sf):
    points = b.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("method"), F.col("l_linenumber").alias("var"), F.col("l_partkey").alias("obj")).distinct()
    return frontend.may_alias(points)


_OP = "CASE kind WHEN 'ENTRY' THEN 'new' WHEN 'ALLOCATION' THEN 'add' WHEN 'METHOD_CALL' THEN 'remove' WHEN 'SWITCH' THEN 'clear' ELSE 'get' END"


@query(
    b.with_sql("stmt")[:-1]
    + f""", ops AS (SELECT method, {_VAR} AS var, ordinal, {_OP} AS op FROM stmt), aged AS (SELECT *, SUM(CASE WHEN op IN ('new', 'clear') THEN 1 ELSE 0 END) OVER (PARTITION BY method, var ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS age FROM ops)
    SELECT method, var, ordinal, op, CAST(COALESCE(SUM(CASE op WHEN 'add' THEN 1 WHEN 'remove' THEN -1 ELSE 0 END) OVER (PARTITION BY method, var, age ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS size FROM aged"""
)
def list_sizes(spark, sf):
    ops = b.statements(spark, sf).selectExpr("method", f"{_VAR} AS var", "ordinal", f"{_OP} AS op")
    return frontend.list_sizes(ops)


@query(
    b.with_sql("stmt")[:-1]
    + f""", a AS (SELECT method, {_VAR} AS lhs, ordinal, CASE WHEN kind <> 'IF_CONDITION' THEN value END AS value FROM stmt) SELECT method, lhs, ordinal, lag(value) OVER (PARTITION BY method, lhs ORDER BY ordinal) AS known FROM a"""
)
def constant_values(spark, sf):
    rows = b.statements(spark, sf).selectExpr("method", f"{_VAR} AS lhs", "ordinal", "CASE WHEN kind <> 'IF_CONDITION' THEN value END AS value")
    return frontend.constants(rows).select("method", "lhs", "ordinal", "known")


@query(
    b.with_sql("stmt")[:-1]
    + """, i AS (SELECT method, ordinal, callee % 10 AS lo, callee % 10 + callee % 3 AS hi, lead(callee % 10) OVER w AS lo2, lead(callee % 10 + callee % 3) OVER w AS hi2 FROM stmt WINDOW w AS (PARTITION BY method ORDER BY ordinal))
    SELECT method, ordinal, CASE WHEN lo2 IS NULL THEN NULL WHEN hi < lo2 OR hi2 < lo THEN false WHEN lo = hi AND lo2 = hi2 AND lo = lo2 THEN true END AS meets, COALESCE(lo <= lo2 AND hi2 <= hi, false) AS covers,
    CASE WHEN hi <= lo2 THEN true WHEN lo > hi2 THEN false END AS at_most, CASE WHEN lo2 IS NOT NULL THEN CAST(LEAST(lo, lo2) AS VARCHAR) || '-' || CAST(GREATEST(hi, hi2) AS VARCHAR) END AS hull FROM i"""
)
def container_intervals(spark, sf):
    """Three-valued relations between a position interval and that of the next statement."""
    own = k.interval(F.col("callee") % 10, F.col("callee") % 10 + F.col("callee") % 3)
    order = Window.partitionBy("method").orderBy("ordinal")
    rows = b.statements(spark, sf).withColumn("a", own).withColumn("b", F.lead("a").over(order))
    x, y = F.col("a"), F.col("b")
    hull = k.hull(x, y)
    return rows.select(
        "method", "ordinal", k.intersects(x, y).alias("meets"), k.interval_entails(x, y).alias("covers"), k.before_or_at(x, y).alias("at_most"),
        F.concat(hull["min"].cast("string"), F.lit("-"), hull["max"].cast("string")).alias("hull"),
    )


@query(b.with_sql("edge") + "SELECT DISTINCT 1 AS part, '  \"' || CAST(src AS VARCHAR) || '\" -> \"' || CAST(dst AS VARCHAR) || '\";' AS value FROM edge UNION ALL VALUES (0, 'digraph G {'), (2, '}')")
def call_graph_dot(spark, sf):
    return writers.dot(b.edges(spark, sf))


@query(b.with_sql("edge") + "SELECT src, '{\"' || CAST(src AS VARCHAR) || '\":[' || string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) || ']}' AS document FROM edge GROUP BY src")
def call_graph_json(spark, sf):
    return writers.call_graph_json(b.edges(spark, sf))


_RESULT = """res AS (SELECT 'app' || CAST(o_custkey AS VARCHAR) AS app_id, 'm' || CAST(o_orderkey AS VARCHAR) AS sig, o_orderpriority AS category, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'success' END AS status, o_orderkey FROM orders),
  n AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey)"""


def results(spark, sf):
    """Result rows from orders: an app is a customer, a dangerous method an order, its constraints the line items."""
    items = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("constraints"))
    none = F.array().cast("array<string>")
    return b.table(spark, sf, "orders").join(items, "o_orderkey", "left").select(
        F.concat(F.lit("app"), F.col("o_custkey").cast("string")).alias("app_id"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("sig"), F.col("o_orderpriority").alias("category"), F.lit("HIGH").alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("status"), F.array(F.lit("c")).alias("call_chains"), F.coalesce("constraints", none).alias("constraints"),
    )


@query(f"WITH {_RESULT} SELECT COUNT(DISTINCT app_id) AS apps, COUNT(*) AS apis, COUNT(*) FILTER (status = 'success') AS successful, CAST(COUNT(*) AS BIGINT) AS chains, CAST(SUM(COALESCE(n, 0)) AS BIGINT) AS constraints FROM res LEFT JOIN n ON l_orderkey = o_orderkey")
def batch_summary(spark, sf):
    return writers.batch_summary(results(spark, sf))


@query(
    f"""WITH {_RESULT} SELECT app_id, COUNT(*) AS total_dangerous_apis, COUNT(*) FILTER (status = 'success') AS successful, CAST(SUM(COALESCE(n, 0)) AS BIGINT) AS total_constraints,
    COUNT(DISTINCT category) AS n_categories FROM res LEFT JOIN n ON l_orderkey = o_orderkey GROUP BY app_id"""
)
def app_documents(spark, sf):
    """Figures read back from each app's JSON document."""
    docs = writers.api_documents(results(spark, sf))
    parsed = F.from_json("document", "total_dangerous_apis bigint, successful bigint, total_constraints bigint, category_statistics map<string,bigint>")
    return docs.withColumn("d", parsed).select("app_id", "d.total_dangerous_apis", "d.successful", "d.total_constraints", F.size("d.category_statistics").cast("long").alias("n_categories"))


@query(f"WITH {_RESULT} SELECT sig FROM res WHERE app_id NOT IN (SELECT app_id FROM res WHERE status = 'failed')")
def resumable_batch(spark, sf):
    """Rows of apps that have no failed result, by an anti-join."""
    rows = results(spark, sf)
    return rows.join(rows.where("status = 'failed'").select("app_id").distinct(), "app_id", "left_anti").select("sig")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, COUNT(*) AS n, round(SUM(value), 2) AS total FROM events GROUP BY 1, 2")
def streamed_windows(spark, sf):
    """Hourly counts by a file stream with a watermark, run to its end.

    The stream writes the windows that each batch has changed, so state behind the watermark
    is dropped; of a window the last batch counts.
    """
    path = shared_path(spark, "stream")
    rows = streams.event_stream(spark, f"{sf}/events.parque[t]", b.table(spark, sf, "events").schema)
    made = streams.windowed_counts(rows, "1 hour", "1 day")
    name = uuid.uuid4().hex

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/{name}/out/batch={batch_id}")  # a repeated batch is written again

    made.writeStream.outputMode("update").option("checkpointLocation", f"{path}/{name}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/{name}/out").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(b.with_sql("edge_cyc") + "SELECT COUNT(DISTINCT src) AS methods, COUNT(*) AS calls, COUNT(DISTINCT dst) AS callees FROM edge_cyc")
def call_graph_totals(spark, sf):
    return b.edges_cyc(spark, sf).agg(F.count_distinct("src").alias("methods"), F.count("*").alias("calls"), F.count_distinct("dst").alias("callees"))


@query(
    b.with_sql("edge", "sinks", recursive=True)[:-1]
    + """, calls AS (SELECT dst AS src, src AS dst, row_number() OVER (PARTITION BY dst ORDER BY src) AS rank FROM edge), p(path, depth) AS (SELECT [node], 0 FROM sinks UNION ALL
    SELECT list_append(path, c.dst), depth + 1 FROM p JOIN calls c ON c.src = path[-1] WHERE rank <= CASE depth WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 1 END AND NOT list_contains(path, c.dst) AND depth < 50),
    done AS (SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.src = path[-1])), u AS (SELECT unnest(path) AS method FROM done) SELECT method, COUNT(*) AS n_paths FROM u GROUP BY method"""
)
def method_coverage(spark, sf):
    """How many backward paths each method is on."""
    paths = recursion.caller_paths(b.edges(spark, sf), b.sinks(spark, sf))
    return paths.select(F.explode("path").alias("method")).groupBy("method").agg(F.count("*").alias("n_paths"))


@query(
    "SELECT SUM(CASE WHEN value >= 1 THEN value END)::DOUBLE AS seconds, MAX(CASE WHEN event_type = 'view' THEN user_id ELSE -1 END) AS memory FROM events".replace("SUM(CASE WHEN value >= 1 THEN value END)::DOUBLE", "round(SUM(CASE WHEN value >= 1 THEN value END), 2)")
)
def performance_merge(spark, sf):
    """Sums of seconds and the most memory; negative values are unset."""
    runs = b.table(spark, sf, "events").select(F.when(F.col("value") >= 1, F.col("value")).otherwise(-1.0).alias("seconds"), F.when(F.col("event_type") == "view", F.col("user_id")).otherwise(-1).alias("memory"))
    return stats.performance(runs, ["seconds"], ["memory"]).select(F.round("seconds", 2).alias("seconds"), "memory")
