"""Specification files and documents written from the test tables and read back by their readers.

Each query writes its file into a fresh folder below the shared one, so that executors see it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailhead.plans import binding as b
from trailhead.plans.flow_queries import _RESULT, results
from trailhead.plans.registry import query
from trailhead.plans.rule_queries import _PATHS, constraint_paths
from trailhead.sources import readers, writers
from trailhead.storage import shared_path

_SIG = "'<' || class || '$' || CAST(method_id AS VARCHAR(20)) || ': ' || ret || ' ' || name || '(' || params || ')>'"
_M = b.with_sql("method")[:-1] + f", m AS (SELECT *, {_SIG} AS full_sig FROM method)"


def _folder(spark, name: str) -> str:
    return shared_path(spark, f"files/{name}-{uuid.uuid4().hex}")


def _methods(spark, sf):
    return b.methods(spark, sf).selectExpr("*", f"{_SIG} AS full_sig")


def _written(rows, path: str):
    """Text files of lines (rows have a column value) in no order, by as many tasks as there are."""
    rows.select("value").write.text(path)
    return path


def _documents(rows, path: str):
    """A text file for each document (rows have doc and value), of its lines in the order of the column at, if there."""
    lines = F.array_sort(F.collect_list(F.struct("at", "value"))) if "at" in rows.columns else F.collect_list(F.struct("value"))
    whole = rows.groupBy("doc").agg(F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("value"))
    whole.repartition("doc").write.partitionBy("doc").text(path)
    return path


@query(_M + " SELECT category, severity, 'about ' || category AS description, full_sig AS sig FROM m WHERE dangerous")
def catalog_scan(spark, sf):
    """The catalog of sensitive methods as JSON documents, one for each category."""
    rows = _methods(spark, sf).where("dangerous").groupBy("category").agg(F.struct(F.concat(F.lit("about "), F.col("category")).alias("description"), F.min("severity").alias("severity"), F.array_sort(F.collect_list("full_sig")).alias("apis")).alias("v"))
    whole = rows.select(F.col("category").alias("doc"), F.to_json(F.struct(F.create_map("category", "v").alias("api_categories"))).alias("value"))
    return readers.catalog(spark, _documents(whole, _folder(spark, "catalog")))


@query(
    _M + """ SELECT class || '$' || CAST(method_id AS VARCHAR) AS class, ret, name, params, CASE WHEN size % 2 = 0 THEN 'android.permission.A android.permission.B' ELSE '' END AS permissions,
    size % 3 IN (0, 2) AS is_source, size % 3 IN (1, 2) AS is_sink FROM m"""
)
def source_sink_lines(spark, sf):
    """Sources and sinks as lines of text, with and without permissions."""
    line = "full_sig || CASE WHEN size % 2 = 0 THEN ' android.permission.A android.permission.B' ELSE '' END || ' -> ' || CASE size % 3 WHEN 0 THEN '_SOURCE_' WHEN 1 THEN '_SINK_' ELSE '_BOTH_' END AS value"
    head = spark.createDataFrame([("% a comment",), ("",)], "value string")
    found = readers.source_sink_text(spark, _written(head.unionByName(_methods(spark, sf).selectExpr(line)), _folder(spark, "sources")))
    return found.select("class", "ret", "name", F.array_join("params", ",").alias("params"), F.array_join("permissions", " ").alias("permissions"), "is_source", "is_sink")


@query(_M + " SELECT full_sig AS sig, upper(category) AS category, true AS is_source FROM m WHERE upper(category) IN ('PROMO', 'LARGE')")
def categorised_lines(spark, sf):
    """Lines with their category at the end, of which two categories are taken."""
    lines = _methods(spark, sf).selectExpr("full_sig || ' (' || upper(category) || ')' AS value")
    return readers.categorised_text(spark, _written(lines, _folder(spark, "categories")), ["PROMO", "LARGE"])


@query(_M + " SELECT full_sig AS sig, CASE size % 3 WHEN 0 THEN 'P.A' WHEN 1 THEN 'P.A|P.B' ELSE '' END AS permissions FROM m")
def permission_table(spark, sf):
    """Permissions of methods as a table with quoted lists."""
    path = _folder(spark, "permissions")
    cls, method = "class || '$' || CAST(method_id AS STRING) AS CallerClass", "ret || ' ' || name || '(' || params || ')' AS CallerMethod"
    _methods(spark, sf).selectExpr(cls, method, "CASE size % 3 WHEN 0 THEN 'P.A' WHEN 1 THEN 'P.A, P.B' ELSE ' ' END AS Permission").write.option("header", True).csv(path)
    return readers.permission_csv(spark, path).select("sig", F.array_join("permissions", "|").alias("permissions"))


@query(
    _M + """ SELECT full_sig AS sig, string_agg(p, '|' ORDER BY p) AS permissions FROM (SELECT DISTINCT full_sig, 'perm.' || category AS p FROM m UNION SELECT full_sig, 'perm.all' FROM m WHERE size % 2 = 0) x GROUP BY full_sig"""
)
def permission_blocks(spark, sf):
    """Callers below the permission that they need, a file for each permission."""
    own = _methods(spark, sf).select(F.concat(F.lit("perm."), "category").alias("p"), "full_sig").unionByName(_methods(spark, sf).where("size % 2 = 0").select(F.lit("perm.all").alias("p"), "full_sig"))
    lines = own.select(F.col("p").alias("doc"), F.lit(1).alias("at"), F.concat("full_sig", F.lit(" (1)")).alias("value"))
    heads = own.select("p").distinct().select(F.col("p").alias("doc"), F.lit(0).alias("at"), F.concat(F.lit("Permission:"), "p").alias("value"))
    found = readers.permission_headers(spark, _documents(heads.unionByName(lines), _folder(spark, "blocks")))
    return found.select("sig", F.array_join("permissions", "|").alias("permissions"))


@query(
    _M + """ SELECT category, full_sig AS sig, 'param' AS position, 0 AS param_index, size % 2 = 0 AS is_source, size % 2 = 1 AS is_sink, CASE WHEN size % 3 = 0 THEN 'f' ELSE '' END AS fields FROM m
    UNION ALL SELECT category, full_sig, 'return', NULL, true, false, '' FROM m"""
)
def source_sink_elements(spark, sf):
    """Sources and sinks by position and access path as XML, a row for each access path."""
    path = _folder(spark, "elements")
    element = "struct<_type: string, _field: string>"
    place = lambda index, source, sink, fields: F.array(F.struct(F.lit("java.lang.String").alias("_type"), F.lit(index).cast("int").alias("_index"), F.array(F.struct(source.alias("_isSource"), sink.alias("_isSink"), fields.alias("pathElement"))).alias("accessPath")))
    none, even = F.array().cast(f"array<{element}>"), F.col("size") % 2 == 0
    fields = F.when(F.col("size") % 3 == 0, F.array(F.struct(F.lit("java.lang.Object").alias("_type"), F.lit("f").alias("_field")))).otherwise(none)
    method = F.struct(F.col("full_sig").alias("_signature"), place(None, F.lit(True), F.lit(False), none).alias("return"), place(0, even, ~even, fields).alias("param"))
    _methods(spark, sf).groupBy(F.col("category").alias("_id")).agg(F.collect_list(method).alias("method")).write.format("xml").option("rowTag", "category").option("rootTag", "sinkSources").save(path)
    found = readers.source_sink_xml(spark, path)
    return found.select("category", "sig", "position", "param_index", "is_source", "is_sink", F.array_join(F.transform("fields", lambda f: f["field"]), ".").alias("fields"))


@query(_M + " SELECT 'h' || CAST(size % 7 AS VARCHAR) AS handle, CASE WHEN dangerous THEN 'sink' ELSE 'source' END AS kind, class || '$' || CAST(method_id AS VARCHAR) AS class, name AS member, size % 4 AS param FROM m")
def policy_documents(spark, sf):
    """Assignables of a policy, written as XML and read again."""
    path = _folder(spark, "policy")
    rows = _methods(spark, sf).selectExpr("'h' || CAST(size % 7 AS STRING) AS handle", "CASE WHEN dangerous THEN 'sink' ELSE 'source' END AS kind", "class || '$' || CAST(method_id AS STRING) AS class", "name AS member", "size % 4 AS param")
    writers.policy_xml(rows, path)
    return readers.rifl(spark, path)


@query(_M + " SELECT CASE size % 4 WHEN 0 THEN 'exclude' WHEN 1 THEN 'kill' WHEN 2 THEN 'prefix' ELSE 'propagate' END AS kind, full_sig AS entry FROM m")
def wrapper_lines(spark, sf):
    """A wrapper list with its four kinds of lines and comments."""
    lines = _methods(spark, sf).selectExpr("CASE size % 4 WHEN 0 THEN '~' WHEN 1 THEN '-' WHEN 2 THEN '^' ELSE '' END || full_sig AS value")
    head = spark.createDataFrame([("# a comment",), ("",)], "value string")
    return readers.wrapper_list(spark, _written(head.unionByName(lines), _folder(spark, "wrappers")))


@query(_M + " SELECT DISTINCT class AS name FROM m")
def callback_names(spark, sf):
    return readers.name_list(spark, _written(_methods(spark, sf).select(F.concat(F.lit("  "), "class").alias("value")), _folder(spark, "names")))


@query(b.with_sql("edge_cyc") + "SELECT 'm' || CAST(src AS VARCHAR) AS src, 'm' || CAST(dst AS VARCHAR) AS dst FROM edge_cyc")
def call_graph_round_trip(spark, sf):
    """The call graph written as JSON, a line for each caller, and read again."""
    name = lambda c: F.concat(F.lit("m"), F.col(c).cast("string")).alias(c)
    docs = writers.call_graph_json(b.edges_cyc(spark, sf).select(name("src"), name("dst")))
    return readers.call_graph_json(spark, _written(docs.select(F.col("document").alias("value")), _folder(spark, "graph")), by_line=True)


@query(
    f"""WITH {_RESULT} SELECT app_id, COUNT(*) AS total, COUNT(DISTINCT category) AS categories, COUNT(*) FILTER (status = 'success') AS successful FROM res GROUP BY 1"""
)
def prior_results(spark, sf):
    """A result document for each app, many to a file, read again as prior results."""
    path = _folder(spark, "results")
    rows = results(spark, sf)
    detail = F.struct(F.col("sig").alias("method_signature"), F.col("category").alias("api_category"), F.col("severity").alias("severity_level"), F.col("status").alias("analysis_status"))
    docs = rows.groupBy("app_id").agg(F.count("*").alias("total_dangerous_apis"), F.collect_list(detail).alias("detailed_results"))
    docs.select(F.to_json(F.struct("app_id", "total_dangerous_apis", "detailed_results")).alias("value")).write.text(path)
    found = readers.result_records(spark, path)
    status = F.transform("detailed_results", lambda r: r["analysis_status"])
    return found.select(
        "app_id", F.col("total_dangerous_apis").cast("long").alias("total"), F.size(F.array_distinct(F.transform("detailed_results", lambda r: r["api_category"]))).cast("long").alias("categories"),
        F.size(F.filter(status, lambda x: x == "success")).cast("long").alias("successful"),
    )


@query(
    "SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS sink_stmt, 'v' || CAST(l_suppkey % 3 AS VARCHAR) AS sink_ap, 'p' || CAST(l_partkey AS VARCHAR) AS source_stmt, 'w' || CAST(l_linenumber AS VARCHAR) AS source_ap FROM lineitem"
)
def flow_documents(spark, sf):
    """Flow results written as XML and read again."""
    path = _folder(spark, "flows")
    text = lambda p, c, n: F.concat(F.lit(p), c.cast("string")).alias(n)
    found = b.table(spark, sf, "lineitem").select(
        text("s", F.col("l_suppkey"), "sink_stmt"), F.lit("m").alias("sink_method"), text("v", F.col("l_suppkey") % 3, "sink_ap"), text("p", F.col("l_partkey"), "source_stmt"), F.lit("m").alias("source_method"), text("w", F.col("l_linenumber"), "source_ap")
    )
    writers.flow_xml(found, path)
    return readers.flow_results_xml(spark, path)


@query(_M + " SELECT category, full_sig AS sig, 'does ' || name AS purpose, ret AS return_type, 'gives ' || ret AS return_description FROM m WHERE dangerous")
def ground_truth_scan(spark, sf):
    """Expected answers for the sensitive methods, from a JSON document for each category."""
    entry = F.struct(F.col("full_sig").alias("signature"), F.concat(F.lit("does "), "name").alias("purpose_behavior"), F.struct(F.col("ret").alias("type"), F.concat(F.lit("gives "), "ret").alias("description")).alias("return_values"))
    rows = _methods(spark, sf).where("dangerous").groupBy("category").agg(F.collect_list(entry).alias("v"))
    whole = rows.select(F.col("category").alias("doc"), F.to_json(F.struct(F.create_map("category", "v").alias("framework_methods"))).alias("value"))
    return readers.ground_truth(spark, _documents(whole, _folder(spark, "truth")))


@query(
    _M + """ SELECT kind, name, exported, true AS enabled, CASE WHEN exported THEN 'a.MAIN|a.VIEW' ELSE '' END AS actions FROM (SELECT CASE size % 4 WHEN 0 THEN 'activity' WHEN 1 THEN 'service' WHEN 2 THEN 'receiver' ELSE 'provider' END AS kind,
    class || '$' || CAST(method_id AS VARCHAR) AS name, size % 3 = 0 AS exported, size % 5 <> 0 AS live FROM m) x WHERE live"""
)
def manifest_components(spark, sf):
    """Components of text manifests, one for each app, with their filters; switched-off ones are left out."""
    name = "class || '$' || CAST(method_id AS STRING)"
    kind = "CASE size % 4 WHEN 0 THEN 'activity' WHEN 1 THEN 'service' WHEN 2 THEN 'receiver' ELSE 'provider' END"
    filters = "CASE WHEN size % 3 = 0 THEN '<intent-filter><action android:name=\"a.MAIN\"/><action android:name=\"a.VIEW\"/></intent-filter>' ELSE '' END"
    line = f"'<' || {kind} || ' android:name=\"' || {name} || '\" android:exported=\"' || CAST(size % 3 = 0 AS STRING) || '\" android:enabled=\"' || CAST(size % 5 <> 0 AS STRING) || '\">' || {filters} || '</' || {kind} || '>' AS value"
    rows = _methods(spark, sf).selectExpr("class AS doc", "1 AS at", line)
    ends = "explode(array(struct(0 AS at, '<manifest package=\"com.app\"><application>' AS value), struct(2 AS at, '</application></manifest>' AS value))) AS x"
    frame = rows.select("doc").distinct().selectExpr("doc", ends).selectExpr("doc", "x.at", "x.value")
    found = readers.manifest(spark, _documents(frame.unionByName(rows), _folder(spark, "manifest")))
    return found.select("kind", "name", "exported", "enabled", F.array_join("actions", "|").alias("actions"))


@query(_M + " SELECT 'com.widget.' || category AS view, name AS method, COUNT(*) AS n FROM m WHERE size % 2 = 0 GROUP BY category, name")
def layout_click_handlers(spark, sf):
    """Views of text layouts that name a click handler."""
    line = "'<com.widget.' || category || ' android:id=\"@+id/v' || CAST(method_id AS STRING) || '\"' || CASE WHEN size % 2 = 0 THEN ' android:onClick=\"' || name || '\"' ELSE '' END || '/>' AS value"
    found = readers.layout_callbacks(spark, _written(_methods(spark, sf).selectExpr(line), _folder(spark, "layouts")))
    return found.groupBy("view", "method").agg(F.count("*").alias("n"))


@query(
    _M + """ SELECT 'com.app' AS package, class || '$' || CAST(method_id AS VARCHAR) AS name, CASE size % 4 WHEN 0 THEN 'ACTIVITY' WHEN 1 THEN 'SERVICE' WHEN 2 THEN 'RECEIVER' ELSE 'PROVIDER' END AS kind, size % 3 = 0 AS exported,
    CASE WHEN size % 2 = 0 THEN 'act.' || category ELSE '' END AS actions FROM m"""
)
def component_model_scan(spark, sf):
    """Component models as protobuf text, one for each app."""
    kind = "CASE size % 4 WHEN 0 THEN 'ACTIVITY' WHEN 1 THEN 'SERVICE' WHEN 2 THEN 'RECEIVER' ELSE 'PROVIDER' END"
    action = "CASE WHEN size % 2 = 0 THEN '  filters {\\n    attributes {\\n      kind: ACTION\\n      value: \"act.' || category || '\"\\n    }\\n  }\\n' ELSE '' END"
    text = f"'components {{\\n  name: \"' || class || '$' || CAST(method_id AS STRING) || '\"\\n  kind: ' || {kind} || '\\n' || CASE WHEN size % 3 = 0 THEN '  exported: true\\n' ELSE '' END || {action} || '}}' AS value"
    rows = _methods(spark, sf).selectExpr("class AS doc", "1 AS at", text)
    head = rows.select("doc").distinct().selectExpr("doc", "0 AS at", "'name: \"com.app\"' AS value")
    found = readers.component_models(spark, _documents(head.unionByName(rows), _folder(spark, "models")))
    return found.select("package", "name", "kind", "exported", F.array_join("actions", "|").alias("actions"))


# -- reports


@query(
    f"""WITH {_RESULT} SELECT app_id, 'Method: ' || sig || chr(10) || 'Category: ' || category || ' (HIGH)' || chr(10) || 'Status: ' || status || chr(10) || 'Call chains: 1' || chr(10) || 'Constraints: ' || CAST(COALESCE(n, 0) AS VARCHAR) AS value FROM res LEFT JOIN n ON l_orderkey = o_orderkey"""
)
def readable_report(spark, sf):
    return writers.report(results(spark, sf))


@query(
    f"""WITH {_PATHS} SELECT CAST(o_custkey AS BIGINT) AS "Method", COUNT(*) AS "Total", COUNT(*) FILTER (valid) AS "Valid", COUNT(*) FILTER (NOT valid) AS "Invalid", round(AVG(n), 2) AS "AvgConstraints" FROM orders JOIN path p ON p.path_id = o_orderkey GROUP BY o_custkey"""
)
def constraint_report(spark, sf):
    orders = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path_id"), F.col("o_custkey").cast("long").alias("o_custkey"))
    return writers.constraint_csv(constraint_paths(spark, sf).join(orders, "path_id"), "o_custkey")


@query(
    b.with_sql("edge")
    + """SELECT DISTINCT 1 AS part, '<node id="' || CAST(n AS VARCHAR) || '" label="' || CAST(n AS VARCHAR) || '"/>' AS value FROM (SELECT src AS n FROM edge UNION SELECT dst FROM edge) x
    UNION ALL SELECT DISTINCT 3, '<edge source="' || CAST(src AS VARCHAR) || '" target="' || CAST(dst AS VARCHAR) || '"/>' FROM edge
    UNION ALL VALUES (0, '<gexf version="1.2"><graph defaultedgetype="directed"><nodes>'), (2, '</nodes><edges>'), (4, '</edges></graph></gexf>')"""
)
def call_graph_gexf(spark, sf):
    return writers.gexf(b.edges(spark, sf))


@query(
    """SELECT conv_id AS session, COUNT(*) AS turns, COUNT(DISTINCT role) AS roles, CAST(SUM(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id"""
)
def interaction_log(spark, sf):
    """Figures read back from the log of each session."""
    docs = writers.log_documents(b.table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text"))
    d = docs.withColumn("d", F.from_json("value", "turn int, role string, text string"))
    return d.groupBy("session").agg(F.count("*").alias("turns"), F.count_distinct("d.role").alias("roles"), F.sum(F.length("d.text")).alias("n_chars"))
