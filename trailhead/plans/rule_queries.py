"""Scalar functions, windows, constraints, aggregates and set operations on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailhead.functions import text as t
from trailhead.operators import constraints as c
from trailhead.operators import stats
from trailhead.plans import binding as b
from trailhead.plans.registry import query

# -- scalar functions


@query(
    b.with_sql("method")
    + r"""SELECT method_id, regexp_extract(sig, '^<([^:]+):', 1) AS class, regexp_extract(sig, ': (\S+) ', 1) AS ret, regexp_extract(sig, ' ([^(\s]+)\(', 1) AS name,
    regexp_extract(sig, '\(([^)]*)\)', 1) AS params, len(string_split(regexp_extract(sig, '\(([^)]*)\)', 1), ',')) AS n_params, substr(sig, strpos(sig, ': ') + 2, length(sig) - strpos(sig, ': ') - 2) AS sub_sig FROM method"""
)
def signature_parts(spark, sf):
    sig = F.regexp_replace("sig", r"#\d+>$", ">")
    s = t.signature(sig)
    rows = b.methods(spark, sf).select("method_id", "sig", s.alias("s"))
    return rows.select(
        "method_id", "s.class", "s.ret", "s.name", F.array_join("s.params", ",").alias("params"), F.size("s.params").cast("long").alias("n_params"), t.sub_signature("sig").alias("sub_sig")
    )


_PATH_TYPE = """CASE WHEN contains(lower(sig), 'oncreate') OR contains(lower(sig), 'onstart') OR contains(lower(sig), 'onresume') THEN 'activity_lifecycle'
    WHEN contains(lower(sig), 'onclick') OR contains(lower(sig), 'ontouch') OR contains(lower(sig), 'onkey') THEN 'user_interaction'
    WHEN contains(lower(sig), 'onstartcommand') OR contains(lower(sig), 'onbind') THEN 'service_lifecycle' WHEN contains(lower(sig), 'onreceive') THEN 'broadcast_receiver'
    WHEN contains(lower(sig), 'run') OR contains(lower(sig), 'doinbackground') THEN 'background_thread'
    WHEN contains(lower(sig), 'onoptionsitemselected') OR contains(lower(sig), 'onmenuitemclick') THEN 'menu_interaction' ELSE 'application_method' END"""
_LIFECYCLE = """CASE WHEN name IN ('onCreate', 'onStart', 'onResume', 'onPause', 'onStop', 'onDestroy', 'onCreateView', 'onViewCreated', 'onDestroyView', 'onStartCommand', 'onBind', 'onUnbind', 'onReceive', 'doWork') THEN name END"""


@query(
    b.with_sql("method")
    + f"""SELECT method_id, {_PATH_TYPE} AS path_type, {_LIFECYCLE} AS lifecycle,
    regexp_matches(lower(name), 'click|save|delete|update|menu|button|touch|submit|send|create') AS interesting, name NOT IN ('<init>', '<clinit>') AND (starts_with(name, 'on') OR name IN ('query', 'insert', 'update', 'delete')) AS entry,
    regexp_matches(class, '^(android|com\\.android|java|javax|com\\.google\\.android|com\\.facebook|com\\.paypal|ly\\.kite|io\\.card|com\\.stripe|com\\.crashlytics|com\\.appsflyer)\\.') AS framework, split_part(class, '.', 1) || '.' || split_part(class, '.', 2) AS root,
    CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 END AS severity_rank FROM method"""
)
def method_labels(spark, sf):
    return b.methods(spark, sf).select(
        "method_id", t.path_type("sig").alias("path_type"), t.lifecycle("name").alias("lifecycle"), t.interesting("name").alias("interesting"),
        t.likely_entry("name", F.lit("ContentProvider")).alias("entry"), t.framework_package("class").alias("framework"), t.root_package("class").alias("root"), t.severity_rank("severity").alias("severity_rank"),
    )


#: Raw conditions made from events: words of the intermediate language between a variable and a number.
_RAW = "'$i' || CAST(user_id AS VARCHAR(20)) || CASE event_id % 6 WHEN 0 THEN ' gt ' WHEN 1 THEN ' lt ' WHEN 2 THEN ' ge ' WHEN 3 THEN ' le ' WHEN 4 THEN ' eq ' ELSE ' ne ' END || CAST(event_id % 10 AS VARCHAR(20))"
_FALL = "replace(replace(replace(replace(replace(replace(replace(raw, '$', 'var_'), ' gt ', ' > '), ' lt ', ' < '), ' ge ', ' >= '), ' le ', ' <= '), ' eq ', ' == '), ' ne ', ' != ')"


@query(
    f"""WITH e AS (SELECT event_id, event_type, event_id % 2 = 0 AS branch, {_RAW} AS raw FROM events), f AS (SELECT *, CASE WHEN branch THEN '[' || {_FALL} || ']' ELSE '[!(' || {_FALL} || ')]' END AS text FROM e)
    SELECT event_id, text, regexp_extract(text, '([\\w.]+)\\s*(==|!=|>=|<=|>|<)\\s*(\\w+)', 1) AS variable, regexp_extract(text, '([\\w.]+)\\s*(==|!=|>=|<=|>|<)\\s*(\\w+)', 2) AS operator,
    regexp_extract(text, '([\\w.]+)\\s*(==|!=|>=|<=|>|<)\\s*(\\w+)', 3) AS value, COALESCE(NULLIF(regexp_extract(text, '([\\w.]+)\\s*==', 1), ''), 'switch_var') AS switch_variable,
    CASE event_type WHEN 'view' THEN '[switch_var == default]' ELSE '[switch_var == ' || event_type || ']' END AS switch_text,
    replace(raw, '$', 'var_') || CASE event_type WHEN 'view' THEN '_int' WHEN 'click' THEN '_bool' WHEN 'error' THEN '_string' ELSE '' END AS variable_name FROM f"""
)
def condition_texts(spark, sf):
    rows = b.table(spark, sf, "events").selectExpr("event_id", "event_type", "event_id % 2 = 0 AS branch", f"{_RAW} AS raw").withColumn("text", t.fallback_condition("raw", "branch"))
    parsed = t.condition("text", "raw")
    kind = F.when(F.col("event_type") == "view", "int").when(F.col("event_type") == "click", "boolean").when(F.col("event_type") == "error", "java.lang.String").otherwise("double")
    return rows.withColumn("p", parsed).select(
        "event_id", "text", "p.variable", "p.operator", "p.value", t.switch_variable("text").alias("switch_variable"),
        t.fallback_switch("event_type", F.col("event_type") == "view").alias("switch_text"), t.fallback_variable(kind, "raw").alias("variable_name"),
    )


@query(
    r"""WITH turns AS (SELECT conv_id, turn, role, text, LEAD(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
    m AS (SELECT conv_id, turn, 'BRANCH_DIRECTION_START ' || CASE WHEN turn % 4 = 0 THEN 'true' ELSE 'FALSE' END || ' BRANCH_DIRECTION_END BOOLEAN_CONSTRAINT_START' || COALESCE(answer, '') || 'BOOLEAN_CONSTRAINT_END TECHNICAL_CONSTRAINT_START ' ||
      text || ' TECHNICAL_CONSTRAINT_END' AS response FROM turns WHERE role = 'user'),
    p AS (SELECT conv_id, turn, upper(trim(regexp_extract(response, 'BRANCH_DIRECTION_START(.*?)BRANCH_DIRECTION_END', 1, 's'))) = 'TRUE' AS branch,
      NULLIF(trim(regexp_extract(response, 'BOOLEAN_CONSTRAINT_START(.*?)BOOLEAN_CONSTRAINT_END', 1, 's'), chr(32) || chr(9) || chr(13) || chr(10)), '') AS f1, NULLIF(trim(regexp_extract(response, 'TECHNICAL_CONSTRAINT_START(.*?)TECHNICAL_CONSTRAINT_END', 1, 's'), chr(32) || chr(9) || chr(13) || chr(10)), '') AS f3 FROM m)
    SELECT conv_id, turn, branch, COALESCE(f1, 'unknown_condition') AS format1, COALESCE(f1, 'unknown_condition') AS format2, COALESCE(f3, f1, 'unknown_condition') AS format3 FROM p"""
)
def structured_responses_whole(spark, sf):
    """Whole prompts and answers, parsed by their markers, with cross-fill."""
    answer = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = b.table(spark, sf, "conversations").withColumn("answer", answer).where("role = 'user'")
    made = F.concat(
        F.lit("BRANCH_DIRECTION_START "), F.when(F.col("turn") % 4 == 0, "true").otherwise("FALSE"), F.lit(" BRANCH_DIRECTION_END BOOLEAN_CONSTRAINT_START"), F.coalesce("answer", F.lit("")),
        F.lit("BOOLEAN_CONSTRAINT_END TECHNICAL_CONSTRAINT_START "), F.col("text"), F.lit(" TECHNICAL_CONSTRAINT_END"),
    )
    return rows.withColumn("s", t.structured_response(made)).select("conv_id", "turn", "s.branch", "s.format1", "s.format2", "s.format3")


@query(
    r"""SELECT conv_id, turn, CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 60) || '... [+' || CAST(length(text) - 60 AS VARCHAR) || ' chars]' END AS shown,
    replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS json,
    CASE WHEN contains(text, '"') OR contains(text, ',') OR contains(text, chr(10)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS csv,
    replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml, substr(regexp_replace(text, '[^A-Za-z0-9._-]', '_', 'g'), 1, 100) AS file FROM conversations"""
)
def escaped_texts(spark, sf):
    return b.table(spark, sf, "conversations").select(
        "conv_id", "turn", t.truncated("text", 60).alias("shown"), t.json_escaped("text").alias("json"), t.csv_escaped("text").alias("csv"), t.xml_escaped("text").alias("xml"), t.file_name("text").alias("file")
    )


@query(
    """SELECT page_id, array_to_string(list_transform(list_filter(regexp_extract_all(html, '"([^"]*)"', 1), lambda x: contains(x, '/') AND length(x) BETWEEN 2 AND 99), lambda x: 'route:' || x), ' ') AS routes FROM pages"""
)
def resource_literals(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", F.array_join(t.routes("html"), " ").alias("routes"))


@query(
    """WITH c AS (SELECT label, list(embedding ORDER BY vec_id)[1] AS e FROM embeddings GROUP BY label)
    SELECT v.vec_id, v.label, CAST(round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(c.e AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(c.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])))), 6) AS DOUBLE) AS similarity
    FROM embeddings v JOIN c ON v.label = c.label"""
)
def label_similarity(spark, sf):
    """Cosine similarity of each vector to the first of its label."""
    v = b.table(spark, sf, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    return v.join(first, "label").select("vec_id", "label", F.round(t.cosine("embedding", "e"), 6).alias("similarity"))


# -- windows over statements


@query(
    b.with_sql("stmt")
    + "SELECT method, ordinal, stmt_id, kind, COALESCE(CAST(lag(stmt_id) OVER w AS VARCHAR), 'ENTRY') AS pred, COALESCE(CAST(lead(stmt_id) OVER w AS VARCHAR), 'EXIT') AS succ FROM stmt WINDOW w AS (PARTITION BY method ORDER BY ordinal)"
)
def linear_allocation_graph(spark, sf):
    return c.allocation_graph(b.statements(spark, sf))


@query(
    b.with_sql("stmt")
    + "SELECT method, ordinal, stmt_id, last_value(CASE WHEN kind IN ('IF_CONDITION', 'SWITCH') THEN stmt_id END IGNORE NULLS) OVER (PARTITION BY method ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS condition FROM stmt"
)
def predecessor_conditions(spark, sf):
    return c.predecessor_condition(b.statements(spark, sf)).select("method", "ordinal", "stmt_id", "condition")


@query(
    b.with_sql("stmt")
    + """SELECT a.method, a.stmt_id, a.callee, COUNT(p.stmt_id) AS n_constraints, COALESCE(string_agg(CAST(p.stmt_id AS VARCHAR), '>' ORDER BY p.ordinal), '') AS conditions
    FROM stmt a LEFT JOIN stmt p ON p.method = a.method AND p.ordinal < a.ordinal AND p.kind IN ('IF_CONDITION', 'SWITCH') WHERE a.kind = 'METHOD_CALL' GROUP BY a.method, a.stmt_id, a.callee"""
)
def call_constraints(spark, sf):
    rows = c.call_constraints(b.statements(spark, sf))
    text = F.array_join(F.transform("constraints", lambda x: x["stmt_id"].cast("string")), ">")
    return rows.select("method", "stmt_id", "callee", F.size("constraints").cast("long").alias("n_constraints"), text.alias("conditions"))


@query(
    b.with_sql("stmt")
    + "SELECT method, stmt_id, row_number() OVER w AS site, lead(stmt_id) OVER w IS NULL AS is_last, COUNT(*) OVER (PARTITION BY method) AS n_sites FROM stmt WHERE kind = 'METHOD_CALL' WINDOW w AS (PARTITION BY method ORDER BY ordinal)"
)
def call_sites(spark, sf):
    order = Window.partitionBy("method").orderBy("ordinal")
    return b.statements(spark, sf).where("kind = 'METHOD_CALL'").select(
        "method", "stmt_id", F.row_number().over(order).cast("long").alias("site"), F.lead("stmt_id").over(order).isNull().alias("is_last"), F.count("*").over(Window.partitionBy("method")).alias("n_sites")
    )


# -- paths of constraints: a path is an order, its constraints are its line items

_PATHS = """item AS (SELECT l_orderkey AS path_id, CASE l_returnflag WHEN 'A' THEN 'CONDITIONAL' WHEN 'N' THEN 'SWITCH' ELSE 'PARAMETER' END AS kind, CAST(l_suppkey AS VARCHAR) AS method, 'v' || CAST(l_partkey % 5 AS VARCHAR) AS variable,
  '==' AS operator, CAST(l_linenumber % 2 AS VARCHAR) AS value, l_linestatus = 'O' AS branch, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
  pitem AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, variable || operator || value AS text FROM item),
  clash AS (SELECT DISTINCT a.path_id FROM pitem a JOIN pitem b ON a.path_id = b.path_id AND a.i < b.i AND a.kind = b.kind WHERE
   (a.kind = 'CONDITIONAL' AND a.variable = b.variable AND a.value = b.value AND a.branch <> b.branch) OR (a.kind = 'SWITCH' AND a.variable = b.variable AND a.value <> b.value)
   OR (a.kind = 'PARAMETER' AND a.method = b.method AND a.variable = b.variable AND a.value <> b.value)),
  path AS (SELECT path_id, COUNT(*) AS n, path_id NOT IN (SELECT path_id FROM clash) AS valid,
   CASE WHEN COUNT(*) = 1 THEN MIN(text) ELSE string_agg('(' || text || ')', ' AND ' ORDER BY i) END AS combined FROM pitem GROUP BY path_id)"""


def constraint_paths(spark, sf):
    """(path_id, target, methods, constraints, valid, reason) from the line items of orders."""
    items = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("path_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("at"),
        F.struct(
            F.when(F.col("l_returnflag") == "A", "CONDITIONAL").when(F.col("l_returnflag") == "N", "SWITCH").otherwise("PARAMETER").alias("kind"), F.col("l_suppkey").cast("string").alias("method"),
            F.concat(F.lit("v"), (F.col("l_partkey") % 5).cast("string")).alias("variable"), F.lit("==").alias("operator"), (F.col("l_linenumber") % 2).cast("string").alias("value"),
            (F.col("l_linestatus") == "O").alias("branch"), F.concat(F.lit("v"), (F.col("l_partkey") % 5).cast("string"), F.lit("=="), (F.col("l_linenumber") % 2).cast("string")).alias("text"),
        ).alias("c"),
    )
    paths = items.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("constraints"))
    return c.validated(paths.withColumn("methods", F.array_distinct(F.transform("constraints", lambda x: x["method"]))))


@query(f"WITH {_PATHS} SELECT path_id, n AS n_constraints, valid, combined FROM path")
def path_validity(spark, sf):
    """Pairwise compatibility of each path's constraints, and their conjunction."""
    return constraint_paths(spark, sf).select("path_id", F.size("constraints").cast("long").alias("n_constraints"), "valid", c.combined("constraints").alias("combined"))


@query(
    f"""WITH {_PATHS}, m AS (SELECT path_id, method, MIN(i) AS first, COUNT(*) AS k, CASE WHEN COUNT(*) = 1 THEN MIN(text) ELSE string_agg('(' || text || ')', ' AND ' ORDER BY i) END AS e FROM pitem GROUP BY path_id, method)
    SELECT path_id, CASE WHEN COUNT(*) = 1 THEN MIN(e) ELSE string_agg('(' || e || ')', ' AND ' ORDER BY first) END AS expression FROM m GROUP BY path_id"""
)
def path_expressions(spark, sf):
    """Constraints joined within each method, then across methods."""
    return constraint_paths(spark, sf).select("path_id", c.logical_expression("constraints").alias("expression"))


@query(
    f"""WITH {_PATHS}, o AS (SELECT o_custkey, p.* FROM orders JOIN path p ON p.path_id = o_orderkey), k AS (SELECT o_custkey, COUNT(*) FILTER (valid) AS n, string_agg(combined, '|' ORDER BY path_id) FILTER (valid) AS one,
    string_agg('(' || combined || ')', ' OR ' ORDER BY path_id) FILTER (valid) AS many FROM o GROUP BY o_custkey) SELECT o_custkey, CASE n WHEN 0 THEN 'false' WHEN 1 THEN one ELSE many END AS expression FROM k"""
)
def target_disjunctions(spark, sf):
    paths = constraint_paths(spark, sf).select("path_id", "valid", c.combined("constraints").alias("expression"))
    orders = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path_id"), "o_custkey")
    return c.disjunction(paths.join(orders, "path_id"), "o_custkey")


@query(
    f"""WITH {_PATHS}, o AS (SELECT o_custkey, p.path_id, p.variable FROM orders JOIN pitem p ON p.path_id = o_orderkey), n AS (SELECT o_custkey, COUNT(DISTINCT path_id) AS n FROM o GROUP BY o_custkey)
    SELECT o.o_custkey, variable AS item FROM o JOIN n ON n.o_custkey = o.o_custkey GROUP BY o.o_custkey, variable, n HAVING COUNT(DISTINCT path_id) = n"""
)
def common_constraints(spark, sf):
    """Variables that every path of a target constrains."""
    orders = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path_id"), "o_custkey")
    paths = constraint_paths(spark, sf).select("path_id", F.transform("constraints", lambda x: x["variable"]).alias("variables"))
    return c.common(paths.join(orders, "path_id"), "o_custkey", "variables")


@query(
    f"""WITH {_PATHS}, m AS (SELECT path_id, COUNT(DISTINCT method) AS k FROM pitem GROUP BY path_id), o AS (SELECT o_orderpriority, p.*, k FROM orders JOIN path p ON p.path_id = o_orderkey JOIN m ON m.path_id = p.path_id)
    SELECT o_orderpriority, COUNT(*) AS total, COUNT(*) FILTER (valid) AS n_valid, COUNT(*) FILTER (NOT valid) AS n_invalid, AVG(k) AS avg_methods, AVG(n) AS avg_constraints, CAST(MAX(k) AS INT) AS longest, CAST(MIN(k) AS INT) AS shortest FROM o GROUP BY o_orderpriority"""
)
def path_statistics(spark, sf):
    orders = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path_id"), "o_orderpriority")
    return stats.path_statistics(constraint_paths(spark, sf).join(orders, "path_id"), "o_orderpriority")


@query(
    f"""WITH {_PATHS}, per AS (SELECT o_custkey, COUNT(*) AS k, CAST(SUM(n) AS BIGINT) AS c FROM orders JOIN path p ON p.path_id = o_orderkey GROUP BY o_custkey)
    SELECT AVG(k) AS avg_paths, MAX(k) AS max_paths, SUM(c) / SUM(k) AS avg_constraints FROM per"""
)
def method_complexity(spark, sf):
    orders = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path_id"), "o_custkey")
    return stats.complexity(constraint_paths(spark, sf).join(orders, "path_id"), "o_custkey")


@query(
    f"""WITH {_PATHS} SELECT kind, COUNT(*) AS n, COUNT(DISTINCT path_id) AS n_paths FROM pitem GROUP BY kind"""
)
def constraints_by_type(spark, sf):
    rows = constraint_paths(spark, sf).select("path_id", F.explode("constraints").alias("c"))
    return rows.groupBy("c.kind").agg(F.count("*").alias("n"), F.count_distinct("path_id").alias("n_paths"))


@query(f"""WITH {_PATHS} SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '20+' END AS bucket, COUNT(*) AS n_paths, MIN(n) AS least, MAX(n) AS most FROM path GROUP BY bucket""")
def path_length_buckets(spark, sf):
    rows = constraint_paths(spark, sf).select(F.size("constraints").cast("long").alias("n"))
    return rows.groupBy(t.length_bucket("n").alias("bucket")).agg(F.count("*").alias("n_paths"), F.min("n").alias("least"), F.max("n").alias("most"))


# -- call graph statistics, catalogs, sets


@query(b.with_sql("edge_cyc") + "SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS callees FROM edge_cyc GROUP BY src")
def call_graph_export(spark, sf):
    rows = stats.adjacency(b.edges_cyc(spark, sf))
    return rows.select("src", F.array_join(F.transform("callees", lambda x: x.cast("string")), ",").alias("callees"))


@query(
    b.with_sql("edge_cyc", "method")
    + "SELECT m.method_id AS node, COALESCE(i.n, 0) AS callers, COALESCE(o.n, 0) AS callees FROM method m LEFT JOIN (SELECT dst, COUNT(*) AS n FROM edge_cyc GROUP BY dst) i ON i.dst = m.method_id LEFT JOIN (SELECT src, COUNT(*) AS n FROM edge_cyc GROUP BY src) o ON o.src = m.method_id"
)
def call_graph_degrees(spark, sf):
    return stats.degrees(b.edges_cyc(spark, sf), b.methods(spark, sf).select(F.col("method_id").alias("node")))


@query(
    b.with_sql("edge_cyc", "method")
    + "SELECT s.sig AS src, d.sig AS dst FROM edge_cyc e JOIN method s ON s.method_id = e.src JOIN method d ON d.method_id = e.dst WHERE contains(s.sig, 'brand1.') OR contains(d.sig, 'brand1.') OR contains(s.sig, '.PROMO') OR contains(d.sig, '.PROMO')"
)
def filtered_call_graph(spark, sf):
    names = b.methods(spark, sf).select("method_id", "sig")
    rows = b.edges_cyc(spark, sf).join(names.select(F.col("method_id").alias("src"), F.col("sig").alias("s")), "src").join(names.select(F.col("method_id").alias("dst"), F.col("sig").alias("d")), "dst")
    return stats.touching(rows.select(F.col("s").alias("src"), F.col("d").alias("dst")), ["brand1.", ".PROMO"])


@query(b.with_sql("edge_cyc") + "SELECT dst AS node, COUNT(*) AS callers FROM edge_cyc GROUP BY dst ORDER BY callers DESC, node LIMIT 10")
def top_called_methods(spark, sf):
    return stats.top_called(b.edges_cyc(spark, sf))


@query(
    b.with_sql("edge_cyc", "method")
    + "SELECT DISTINCT m.method_id, m.sig, m.category, m.severity FROM edge_cyc e JOIN method m ON m.method_id = e.dst WHERE m.dangerous"
)
def dangerous_call_detection(spark, sf):
    """Distinct called methods that are in the catalog."""
    catalog = b.methods(spark, sf).where("dangerous").select("method_id", "sig", "category", "severity")
    return catalog.join(b.edges_cyc(spark, sf).select(F.col("dst").alias("method_id")), "method_id", "left_semi")


@query(
    b.with_sql("edge_cyc", "method")
    + """, hit AS (SELECT DISTINCT m.sig, m.category FROM edge_cyc e JOIN method m ON m.method_id = e.dst WHERE m.dangerous)
    SELECT c.category, COUNT(h.sig) AS n, COALESCE(string_agg(h.sig, '|' ORDER BY h.sig), '') AS items FROM (SELECT DISTINCT category FROM method) c LEFT JOIN hit h ON h.category = c.category GROUP BY c.category""".replace(", hit AS", "SELECT * FROM (WITH hit AS", 1) + ")"
)
def category_summary(spark, sf):
    """Detected methods by category, empty categories included."""
    categories = b.methods(spark, sf).select("category").distinct()
    made = stats.by_category(dangerous_call_detection(spark, sf), categories)
    return made.select("category", "n", F.array_join("items", "|").alias("items"))


@query(b.with_sql("method") + "SELECT method_id, sig, severity, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END AS rank FROM method WHERE dangerous AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM')")
def severity_priority(spark, sf):
    return stats.prioritised(b.methods(spark, sf).where("dangerous")).select("method_id", "sig", "severity", "rank")


@query(
    b.with_sql("edge_cyc", "stmt")
    + """SELECT * FROM (WITH ag AS (SELECT DISTINCT CAST(callee AS BIGINT) AS callee, method AS caller FROM stmt WHERE kind = 'METHOD_CALL'), cg AS (SELECT DISTINCT dst AS callee, src AS caller FROM edge_cyc)
    SELECT COALESCE(a.callee, c.callee) AS callee, COALESCE(a.caller, c.caller) AS caller, CASE WHEN a.callee IS NULL THEN 'call graph' WHEN c.callee IS NULL THEN 'allocation graph' ELSE 'both' END AS found FROM ag a FULL JOIN cg c ON a.callee = c.callee AND a.caller = c.caller)"""
)
def caller_sources(spark, sf):
    """Callers by the graph that knows them, in one full join instead of three set operations."""
    ag = b.statements(spark, sf).where("kind = 'METHOD_CALL'").select(F.col("callee").cast("long").alias("callee"), F.col("method").alias("caller")).distinct().withColumn("a", F.lit(1))
    cg = b.edges_cyc(spark, sf).select(F.col("dst").alias("callee"), F.col("src").alias("caller")).distinct().withColumn("c", F.lit(1))
    found = F.when(F.col("a").isNull(), "call graph").when(F.col("c").isNull(), "allocation graph").otherwise("both")
    return ag.join(cg, ["callee", "caller"], "full").select("callee", "caller", found.alias("found"))


@query(
    b.with_sql("stmt")
    + "SELECT method, COUNT(*) AS units, COUNT(*) FILTER (kind = 'METHOD_CALL') AS calls, COUNT(*) FILTER (kind IN ('IF_CONDITION', 'SWITCH')) AS branches, COUNT(*) FILTER (kind = 'ALLOCATION') AS allocations, COUNT(DISTINCT callee) FILTER (kind = 'METHOD_CALL') AS callees FROM stmt GROUP BY method"
)
def statement_statistics(spark, sf):
    kind = F.col("kind")
    return b.statements(spark, sf).groupBy("method").agg(
        F.count("*").alias("units"), F.count_if(kind == "METHOD_CALL").alias("calls"), F.count_if(kind.isin("IF_CONDITION", "SWITCH")).alias("branches"),
        F.count_if(kind == "ALLOCATION").alias("allocations"), F.count_distinct(F.when(kind == "METHOD_CALL", F.col("callee"))).alias("callees"),
    )


_EVAL = "SELECT 'm' || CAST(user_id % 5 AS VARCHAR(20)) AS model, event_type AS category, value AS score, event_id % 9 <> 0 AS ok FROM events"


@query(
    f"WITH r AS ({_EVAL}) SELECT model, category, COUNT(*) AS n, AVG(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS success_rate, COALESCE(round(AVG(CASE WHEN ok THEN score END), 6), 0) AS mean_score FROM r GROUP BY GROUPING SETS ((model), (category), (model, category))"
)
def evaluation_aggregates(spark, sf):
    rows = b.table(spark, sf, "events").selectExpr(_EVAL.removeprefix("SELECT ").removesuffix(" FROM events").split(", ")[0], "event_type AS category", "value AS score", "event_id % 9 <> 0 AS ok")
    return stats.evaluation(rows, ["model", "category"], "score", "ok").withColumn("mean_score", F.round("mean_score", 6))


@query(
    b.with_sql("method")
    + "SELECT category, COUNT(*) AS total, COUNT(*) FILTER (size % 2 = 0) AS successful, COUNT(*) FILTER (size % 2 = 1) AS failed, CAST(SUM(size) AS BIGINT) AS constraints FROM method WHERE dangerous GROUP BY category"
)
def app_summary(spark, sf):
    """Counters of final rows by category."""
    rows = b.methods(spark, sf).where("dangerous")
    return rows.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("size") % 2 == 0).alias("successful"), F.count_if(F.col("size") % 2 == 1).alias("failed"), F.sum("size").alias("constraints"))
