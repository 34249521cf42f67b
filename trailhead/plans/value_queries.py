"""Paths, access paths, truth values, flow paths, documents and model answers on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhead.functions import containers
from trailhead.functions import text as t
from trailhead.operators import appgraph, evaluation, reconstruction
from trailhead.plans import binding as b
from trailhead.plans.file_queries import _folder
from trailhead.plans.front_queries import callback_overrides
from trailhead.plans.registry import ORACLES, query
from trailhead.plans.rule_queries import _PATHS, constraint_paths
from trailhead.sources import readers, writers
from trailhead.storage import checkpointed

# -- paths


@query("SELECT l_orderkey AS path_id, COUNT(DISTINCT l_suppkey % 7) < COUNT(*) AS cyclic, bool_or(l_suppkey % 7 = 3) AS has_sink FROM lineitem GROUP BY l_orderkey")
def path_tests(spark, sf):
    """Whether a path repeats a node, and whether it has a sink."""
    paths = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path_id")).agg(F.collect_list(F.col("l_suppkey") % 7).alias("path"))
    hit = appgraph.contains_sink(paths, spark.createDataFrame([(3,)], "node long")).select("path_id", F.lit(True).alias("has_sink"))
    return paths.join(hit, "path_id", "left").select("path_id", appgraph.cyclic("path").alias("cyclic"), F.coalesce("has_sink", F.lit(False)).alias("has_sink"))


_MERGED = """pair AS (SELECT path_id AS l, path_id + 1 AS r FROM path WHERE path_id % 2 = 0 AND path_id + 1 IN (SELECT path_id FROM path)),
  first AS (SELECT p.l, MIN(y.i) AS at FROM pair p JOIN pitem x ON x.path_id = p.l JOIN pitem y ON y.path_id = p.r WHERE x.kind = y.kind AND ((x.kind = 'CONDITIONAL' AND x.variable = y.variable AND x.value = y.value AND x.branch <> y.branch)
    OR (x.kind = 'SWITCH' AND x.variable = y.variable AND x.value <> y.value) OR (x.kind = 'PARAMETER' AND x.method = y.method AND x.variable = y.variable AND x.value <> y.value)) GROUP BY p.l)"""


@query(
    f"""WITH {_PATHS}, {_MERGED}, n AS (SELECT path_id, COUNT(*) AS n FROM pitem GROUP BY path_id)
    SELECT CAST(l AS VARCHAR) || '+' || CAST(r AS VARCHAR) AS path_id, f.at IS NULL AS valid, a.n + CASE WHEN f.at IS NULL THEN z.n ELSE f.at - 1 END AS n_constraints, (SELECT COUNT(DISTINCT method) FROM pitem WHERE path_id IN (l, r)) AS n_methods
    FROM pair LEFT JOIN first f USING (l) JOIN n a ON a.path_id = l JOIN n z ON z.path_id = r WHERE CAST(floor(l / 2) AS BIGINT) % 3 > 0"""
)
def merged_paths(spark, sf):
    """Pairs of paths as one, with the constraints of the right one up to the first that conflicts; not where their targets differ."""
    half = F.floor(F.col("path_id") / 2)
    target = F.when(half % 3 > 0, "t").otherwise((F.col("path_id") % 2).cast("string"))
    one = F.struct(F.col("path_id").cast("string").alias("path_id"), target.alias("target"), "methods", "constraints", F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    paths = constraint_paths(spark, sf).select("path_id", half.alias("half"), one.alias("p"))
    pairs = paths.where("path_id % 2 = 0").select("half", F.col("p").alias("left")).join(paths.where("path_id % 2 = 1").select("half", F.col("p").alias("right")), "half")
    made = pairs.select(appgraph.merged(F.col("left"), F.col("right")).alias("m")).where("m IS NOT NULL")
    return made.select("m.path_id", "m.valid", F.size("m.constraints").cast("long").alias("n_constraints"), F.size("m.methods").cast("long").alias("n_methods"))


@query(
    f"""WITH {_PATHS}, m AS (SELECT path_id, method, MIN(i) AS first FROM pitem GROUP BY path_id, method), o AS (SELECT path_id, method, row_number() OVER (PARTITION BY path_id ORDER BY first) AS k FROM m)
    SELECT path_id, 'Target: t' || CAST(path_id % 5 AS VARCHAR) || chr(10) || 'Valid: ' || CASE WHEN valid THEN 'true' ELSE 'false' END || chr(10) || 'Constraints: ' || combined || chr(10) || 'Methods:' || chr(10)
    || (SELECT string_agg('  ' || CAST(k AS VARCHAR) || '. ' || method, chr(10) ORDER BY k) FROM o WHERE o.path_id = path.path_id) AS value FROM path"""
)
def path_descriptions(spark, sf):
    """A readable text of each path."""
    return appgraph.described(constraint_paths(spark, sf).withColumn("target", F.concat(F.lit("t"), (F.col("path_id") % 5).cast("string"))))


@query(
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS call, 'm' || CAST(l_suppkey % 20 AS VARCHAR) AS callee, 'a' || CAST(l_partkey AS VARCHAR) AS a0, 'b' || CAST(l_suppkey AS VARCHAR) AS a1, l_suppkey % 20 AS k FROM lineitem)
    SELECT call, callee, a0 AS actual, 'p0' AS formal FROM c UNION ALL SELECT call, callee, a1, 'p1' FROM c WHERE k % 2 = 0 UNION ALL SELECT call, 'run', a1, 'this' FROM c WHERE k = 4"""
)
def argument_pairs(spark, sf):
    """Arguments with the parameters that they become, also in methods that a call starts indirectly."""
    calls = b.table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS call", "'m' || CAST(l_suppkey % 20 AS STRING) AS callee", "array('a' || CAST(l_partkey AS STRING), 'b' || CAST(l_suppkey AS STRING)) AS args")
    formals = spark.range(20).selectExpr("'m' || CAST(id AS STRING) AS callee", "CASE WHEN id % 2 = 0 THEN array('p0', 'p1') ELSE array('p0') END AS names")
    return appgraph.argument_map(calls, formals, spark.createDataFrame([("m4", "run", 1, "this")], "callee string, target string, position int, formal string"))


@query("SELECT l_orderkey AS path_id, '{''entry'': ''' || MIN(CAST(l_suppkey AS VARCHAR)) FILTER (i = 1) || ''', ''executions'': [' || string_agg('(''' || CAST(l_suppkey AS VARCHAR) || ''', ' || CAST(l_linenumber % 3 AS VARCHAR) || ')', ', ' ORDER BY i) || ']}' AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS i FROM lineitem) t GROUP BY l_orderkey")
def guidance_texts(spark, sf):
    """Texts that guide a symbolic executor along each path."""
    step = F.struct(F.struct("l_linenumber", "l_suppkey").alias("at"), F.col("l_suppkey").alias("method"), F.expr("CASE l_linenumber % 3 WHEN 0 THEN CAST(array() AS ARRAY<INT>) WHEN 1 THEN array(1) ELSE array(1, 2) END").alias("blocks"))
    return writers.guidance(b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path_id")).agg(F.array_sort(F.collect_list(step)).alias("executions")))


# -- values

_PUT = "CASE p_partkey % 7 WHEN 0 THEN 'putString' WHEN 1 THEN 'putExtra' WHEN 2 THEN 'putInt' WHEN 3 THEN 'getString' WHEN 4 THEN 'put' WHEN 5 THEN 'putStringArrayList' ELSE 'output' END"


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'String' WHEN 1 THEN 'Object' WHEN 2 THEN 'Int' WHEN 5 THEN 'StringArrayList' END AS stored FROM part")
def bundle_types(spark, sf):
    """Types that calls store in a bundle."""
    return b.table(spark, sf, "part").select("p_partkey", t.bundle_type(F.expr(_PUT)).alias("stored"))


_LISTS = """CASE l_partkey % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} ELSE {4} END AS a, CASE l_suppkey % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {5} END AS p"""


def _lists(empty, make):
    return _LISTS.format(empty, *(make(x) for x in (["f"], ["f", "g"], ["f", "f", "g", "g", "f"], ["this$0", "this$0", "h"], ["h"])))


_AP = "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + _lists("CAST([] AS VARCHAR[])", repr) + " FROM lineitem)"


@query(
    _AP
    + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_concat(a, p)[1:5], '.') AS appended, len(a) + len(p) > 5 AS cut_off, array_to_string(a[1:greatest(len(a) - 1, 0)], '.') AS shorter,
    CASE WHEN a[1:len(p)] = p THEN array_to_string(list_concat(['z'], a[len(p) + 1:]), '.') END AS rebased, CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'f' WHEN 2 THEN 'f.g' WHEN 3 THEN 'f.g.f' ELSE 'this$0.h' END AS reduced,
    CASE WHEN len(a) <= len(p) THEN p[1:len(a)] = a AND (l_linenumber % 2 = 0 OR len(a) = len(p)) ELSE len(p) = 0 END AS entails FROM x"""
)
def access_path_steps(spark, sf):
    """Access paths appended, shortened, rebased, without repeats, and whether one covers another."""
    spell = lambda x: "array(" + ", ".join(repr(v) for v in x) + ")"
    rows = b.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(f"{x} END AS {n}" for x, n in zip(_lists("CAST(array() AS ARRAY<STRING>)", spell).replace(" END AS a, ", "|").replace(" END AS p", "").split("|"), "ap", strict=True)))
    a, p, base = F.col("a"), F.col("p"), F.lit("v")
    joined = lambda c: F.array_join(c, ".")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", joined(containers.append(a, p)["fields"]).alias("appended"), containers.append(a, p)["cut_off"].alias("cut_off"), joined(containers.drop_last(a)).alias("shorter"),
        joined(containers.rebased(a, p, F.array(F.lit("z")))).alias("rebased"), joined(containers.without_loops(a)).alias("reduced"), containers.path_entails(base, a, F.col("l_linenumber") % 2 == 0, base, p).alias("entails"),
    )


@query("SELECT event_id, CASE floor(event_id / 3) % 3 WHEN 1 THEN 'int' WHEN 2 THEN 'int[]' ELSE 'a.B[][]' END AS element, 'T' || event_type || CASE WHEN event_id % 2 = 0 THEN '[]' ELSE '[][]' END AS wider FROM events")
def array_types(spark, sf):
    """Element types of arrays, and types with more dimensions."""
    kind = "element_at(array('a.B[][][]', 'int[]', 'int[][]'), CAST(floor(event_id / 3) % 3 AS INT) + 1)"
    wide = F.concat(F.lit("T"), F.col("event_type"))
    return b.table(spark, sf, "events").select("event_id", containers.element_type(F.expr(kind)).alias("element"), F.when(F.col("event_id") % 2 == 0, containers.more_dims(wide)).otherwise(containers.more_dims(wide, 2)).alias("wider"))


_TRUTH = "CASE {0} % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'T' ELSE 'M' END"
_X, _Y = _TRUTH.format("event_id"), _TRUTH.format("CAST(floor(event_id / 3) AS INT)")


@query(
    f"""WITH v AS (SELECT event_id, {_X} AS x, {_Y} AS y FROM events) SELECT event_id, CASE WHEN 'F' IN (x, y) THEN 'F' WHEN 'M' IN (x, y) THEN 'M' ELSE 'T' END AS both, CASE WHEN 'T' IN (x, y) THEN 'T' WHEN 'M' IN (x, y) THEN 'M' ELSE 'F' END AS either,
    CASE x WHEN 'T' THEN 'F' WHEN 'F' THEN 'T' ELSE 'M' END AS negated FROM v"""
)
def truth_values(spark, sf):
    """Three-valued logic."""
    bool_ = lambda c: F.when(F.expr(c) == "T", True).when(F.expr(c) == "F", False)
    word = lambda c: F.when(c, "T").when(~c, "F").otherwise("M")
    x, y = bool_(_X), bool_(_Y)
    return b.table(spark, sf, "events").select("event_id", word(containers.both(x, y)).alias("both"), word(containers.either(x, y)).alias("either"), word(containers.negated(x)).alias("negated"))


# -- paths of flows

_PRED = """p AS (SELECT method, stmt_id, ordinal, callee, CAST(floor(ordinal / 12) AS INT) AS seg FROM stmt),
  pred AS (SELECT a.stmt_id AS fact, z.stmt_id AS pred, a.stmt_id AS stmt, CASE WHEN a.ordinal % 5 = 0 THEN CAST(a.callee % 3 AS BIGINT) END AS call_site, a.callee % 2 = 0 AS is_return FROM p a JOIN p z ON z.method = a.method AND z.seg = a.seg AND (z.ordinal = a.ordinal - 1 OR a.ordinal % 6 = 0 AND z.ordinal = a.ordinal - 4)),
  ends AS (SELECT arg_max(stmt_id, ordinal) AS sink FROM p GROUP BY method, seg)"""
_WALKS = """walk(sink, fact, stmts, stack) AS (SELECT sink, sink, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM ends UNION ALL SELECT w.sink, q.pred, list_concat([q.stmt], w.stmts), CASE WHEN q.call_site IS NULL THEN w.stack WHEN q.is_return THEN list_append(w.stack, q.call_site) ELSE w.stack[1:greatest(len(w.stack) - 1, 0)] END
    FROM walk w JOIN pred q ON q.fact = w.fact WHERE q.call_site IS NULL OR q.is_return OR len(w.stack) = 0 OR w.stack[len(w.stack)] = q.call_site)"""
_FOUND = f"{b.with_sql('stmt', recursive=True)[:-1]}, {_PRED}, {_WALKS}, found AS (SELECT sink, fact AS source, stmts FROM walk WHERE fact NOT IN (SELECT fact FROM pred))"


def _provenance(spark, sf):
    rows = b.statements(spark, sf).select("method", "stmt_id", "ordinal", "callee", F.floor(F.col("ordinal") / 12).alias("seg"))
    steps = rows.select("method", "seg", F.col("stmt_id").alias("fact"), "callee", "ordinal", F.explode(F.when(F.col("ordinal") % 6 == 0, F.array(F.lit(1), F.lit(4))).otherwise(F.array(F.lit(1)))).alias("back"))
    steps = steps.withColumn("at", F.col("ordinal") - F.col("back"))
    earlier = rows.select("method", "seg", F.col("ordinal").alias("at"), F.col("stmt_id").alias("pred"))
    pred = steps.join(earlier, ["method", "seg", "at"]).select("fact", "pred", F.col("fact").alias("stmt"), F.when(F.col("ordinal") % 5 == 0, (F.col("callee") % 3).cast("long")).alias("call_site"), (F.col("callee") % 2 == 0).alias("is_return"))
    return pred, rows.groupBy("method", "seg").agg(F.max_by("stmt_id", "ordinal").alias("sink")).select("sink", F.col("sink").alias("fact"))


@query(_FOUND + " SELECT sink, source, array_to_string(stmts, '>') AS path FROM found")
def flow_paths(spark, sf):
    """Paths of flows that respect calls and returns."""
    return reconstruction.paths(*_provenance(spark, sf)).select("sink", "source", F.array_join("path", ">").alias("path"))


@query(f"{b.with_sql('stmt', recursive=True)[:-1]}, {_PRED}, r(sink, fact) AS (SELECT sink, sink FROM ends UNION SELECT r.sink, q.pred FROM r JOIN pred q ON q.fact = r.fact) SELECT sink, fact AS source FROM r WHERE fact NOT IN (SELECT fact FROM pred)")
def flow_sources(spark, sf):
    """Sources and sinks of flows without paths."""
    return reconstruction.sources(*_provenance(spark, sf))


@query(_FOUND + " SELECT sink, source, COUNT(*) AS n_paths, MIN(len(stmts)) AS shortest FROM found GROUP BY sink, source")
def flows_without_paths(spark, sf):
    """One row for each source and sink, that of the shortest path, with the number of paths."""
    found = reconstruction.paths(*_provenance(spark, sf))
    best = reconstruction.path_agnostic(found, ["sink", "source"]).select("sink", "source", F.size("path").cast("long").alias("shortest"))
    return best.join(found.groupBy("sink", "source").agg(F.count("*").alias("n_paths")), ["sink", "source"]).select("sink", "source", "n_paths", "shortest")


@query("SELECT o_custkey AS sink, o_orderkey AS source FROM orders ORDER BY sink, source LIMIT 10")
def first_flows(spark, sf):
    """The first ten flows (the feature is a stop after so many)."""
    return reconstruction.first_k(b.table(spark, sf, "orders").select(F.col("o_custkey").alias("sink"), F.col("o_orderkey").alias("source")), 10)


# -- documents


@query("SELECT DISTINCT 'k' || CAST(n_regionkey AS VARCHAR) AS class, 'm' || CAST(n_nationkey AS VARCHAR) AS method, 'Parameter' AS from_kind, n_nationkey % 3 AS from_param, 'f' || CAST(n_nationkey AS VARCHAR) AS from_fields, 'Return' AS to_kind, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS INT) AS gap, n_nationkey % 4 = 0 AS is_alias FROM nation")
def summary_documents(spark, sf):
    """Library summaries written as XML and read back."""
    rows = b.table(spark, sf, "nation").selectExpr(
        "'k' || CAST(n_regionkey AS STRING) AS class", "'m' || CAST(n_nationkey AS STRING) AS method",
        "named_struct('kind', 'Parameter', 'param', n_nationkey % 3, 'fields', array('f' || CAST(n_nationkey AS STRING))) AS from",
        "named_struct('kind', 'Return', 'param', CAST(NULL AS INT), 'fields', CAST(array() AS ARRAY<STRING>), 'gap', CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END) AS to", "n_nationkey % 4 = 0 AS is_alias",
    )
    path = _folder(spark, "summaries")
    writers.summary_xml(rows, path)
    read = readers.summary_flows(spark, f"{path}/*")
    return read.select("class", "method", F.col("from.kind").alias("from_kind"), F.col("from.param").alias("from_param"), F.array_join("from.fields", ".").alias("from_fields"), F.col("to.kind").alias("to_kind"), F.col("to.gap").alias("gap"), "is_alias")


@query(
    """SELECT 'clear' AS kind, 'k' || CAST(o_custkey % 50 AS VARCHAR) AS class, 'm' || CAST(o_orderkey AS VARCHAR) AS name, 'Parameter' || CAST(o_orderkey % 3 AS VARCHAR) || '.f' AS what FROM orders WHERE o_orderkey % 5 < 2
    UNION ALL SELECT 'flow', 'k' || CAST(o_custkey % 50 AS VARCHAR), 'm' || CAST(o_orderkey AS VARCHAR), 'Field.g' FROM orders WHERE o_orderkey % 5 IN (1, 2)
    UNION ALL SELECT DISTINCT CASE WHEN o_orderkey % 4 = 0 THEN 'superclass' ELSE 'interface' END, 'k' || CAST(o_custkey % 50 AS VARCHAR), '', CASE WHEN o_orderkey % 4 = 0 THEN 'K' ELSE 'I' || CAST(o_orderkey % 4 AS VARCHAR) END FROM orders"""
)
def summary_clears_and_hierarchy(spark, sf):
    """What library methods empty, their flows and the classes above theirs, written as XML and read back."""
    orders = b.table(spark, sf, "orders").selectExpr("'k' || CAST(o_custkey % 50 AS STRING) AS class", "'m' || CAST(o_orderkey AS STRING) AS method", "o_orderkey AS k")
    clears = orders.where("k % 5 < 2").selectExpr("class", "method", "named_struct('kind', 'Parameter', 'param', CAST(k % 3 AS INT), 'fields', array('f')) AS clear")
    end = "named_struct('kind', '{}', 'param', CAST(NULL AS INT), 'fields', array('g')) AS {}"
    flows = orders.where("k % 5 IN (1, 2)").selectExpr("class", "method", end.format("Field", "from"), end.format("Return", "to"), "false AS is_alias")
    edges = orders.selectExpr("class AS sub", "CASE WHEN k % 4 = 0 THEN 'K' ELSE 'I' || CAST(k % 4 AS STRING) END AS sup", "k % 4 <> 0 AS is_interface").distinct()
    path = _folder(spark, "clears")
    writers.summary_xml(flows, path, clears, edges)
    path, what = f"{path}/*", lambda c: F.concat(c["kind"], F.coalesce(c["param"].cast("string"), F.lit("")), F.lit("."), F.array_join(c["fields"], "."))
    cleared = readers.summary_clears(spark, path).select(F.lit("clear").alias("kind"), "class", F.col("method").alias("name"), what(F.col("clear")).alias("what"))
    flowing = readers.summary_flows(spark, path).select(F.lit("flow").alias("kind"), "class", F.col("method").alias("name"), what(F.col("from")).alias("what"))
    above = readers.summary_hierarchy(spark, path).select(F.when(F.col("is_interface"), "interface").otherwise("superclass").alias("kind"), F.col("sub").alias("class"), F.lit("").alias("name"), F.col("sup").alias("what"))
    return cleared.unionByName(flowing).unionByName(above)


@query("WITH p AS (SELECT n_nationkey, n_regionkey % 3 AS prio FROM nation UNION ALL SELECT n_nationkey, 1 FROM nation WHERE n_nationkey % 4 = 0) SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS class, CAST(MIN(prio) AS INT) AS provider FROM p GROUP BY n_nationkey")
def prioritised_summaries(spark, sf):
    """Each method's summary from the first provider that knows it."""
    nation = b.table(spark, sf, "nation").selectExpr("'n' || CAST(n_nationkey AS STRING) AS class", "'m' AS method", "n_regionkey % 3 AS p", "n_nationkey % 4 = 0 AS twice")
    given = [nation.where((F.col("p") == i) | (F.col("twice") & (F.lit(i) == 1))).select("class", "method", F.lit(i).alias("provider")) for i in range(3)]
    return readers.prioritised(*given).select("class", "provider")


@query("SELECT 'out/' || CAST(p_partkey AS VARCHAR) || '/analysis_summary.json' AS path FROM part WHERE p_size % 2 = 0")
def kept_result_files(spark, sf):
    """Files of one name that a clean-up keeps."""
    names = "'out/' || CAST(p_partkey AS STRING) || CASE WHEN p_size % 2 = 0 THEN '/analysis_summary.json' ELSE '/x_analysis_summary.json' END AS path"
    return writers.kept_files(b.table(spark, sf, "part").selectExpr(names), "analysis_summary.json")


def callback_cache(spark, sf):
    """Callbacks of components from a cache, which the first use fills."""
    path = _folder(spark, "callbacks")
    readers.cached(spark, path, lambda: callback_overrides(spark, sf))
    return readers.cached(spark, path, lambda: None)  # not made again


query(ORACLES["callback_overrides"])(callback_cache)

# -- answers


def _client():
    """A stand-in for a model: it fails on some prompts and answers others in the wanted form."""

    def ask(prompt):
        if len(prompt) % 3 == 0:
            raise ValueError("no answer")
        return f"BRANCH_DIRECTION_STARTtrueBRANCH_DIRECTION_END BOOLEAN_CONSTRAINT_STARTn == {len(prompt)}BOOLEAN_CONSTRAINT_END"

    return ask


_ANSWERED = "SELECT conv_id || '/' || CAST(turn AS VARCHAR) AS id, COALESCE(length(text), 0) AS n FROM conversations".replace("conv_id ||", "CAST(conv_id AS VARCHAR) ||")


@query(f"WITH a AS ({_ANSWERED}) SELECT id, n % 3 <> 0 AS success, CAST(CASE WHEN n % 3 = 0 THEN 3 ELSE 1 END AS INT) AS attempts, CASE WHEN n % 3 = 0 THEN 'fallback' ELSE 'n == ' || CAST(n AS VARCHAR) END AS format1 FROM a")
def model_answers(spark, sf):
    """Answers of a client that is asked again where it fails, and fallbacks for those that stay open."""
    prompts = b.table(spark, sf, "conversations").selectExpr("CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING) AS id", "COALESCE(text, '') AS prompt")
    answers = checkpointed(evaluation.asked(prompts, _client, wait=0.0))  # each prompt is asked once
    parsed = evaluation.with_fallback(answers.withColumn("fallback", F.lit("fallback")))
    return answers.select("id", "success", "attempts").join(parsed.select("id", "format1"), "id")


_ANSWER = """CASE event_id % 4 WHEN 0 THEN '{"purpose_behavior": "p", "return_values": {"type": "int", "description": "d"}}' WHEN 1 THEN '```json {"purpose_behavior": "q"} ```' WHEN 2 THEN '{"x": 1}' ELSE 'sorry' END"""


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'p' WHEN 1 THEN 'q' END AS purpose, CASE event_id % 4 WHEN 0 THEN 'int' ELSE '' END AS return_type, CASE WHEN event_id % 4 > 1 THEN 'unreadable answer' END AS error FROM events")
def parsed_answers(spark, sf):
    """The parts of answers in JSON, fenced or not, and those that can't be read."""
    made = b.table(spark, sf, "events").select("event_id", evaluation.parsed_answer(F.expr(_ANSWER)).alias("a"))
    return made.select("event_id", F.col("a.purpose_behavior").alias("purpose"), F.coalesce("a.return_type", F.lit("")).alias("return_type"), "a.error")


@query(
    """WITH t AS (SELECT 's' || CAST(p_partkey AS VARCHAR) AS sig FROM part WHERE p_size % 5 > 1), m(model) AS (VALUES ('a'), ('b'), ('c')), done AS (SELECT 's' || CAST(l_partkey AS VARCHAR) AS sig, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'b' ELSE 'z' END AS model FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 25)
    SELECT sig, model FROM t, m WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.sig = t.sig AND d.model = m.model)"""
)
def pending_evaluations(spark, sf):
    """Pairs of methods with a valid truth and models that are not evaluated yet."""
    part = b.table(spark, sf, "part").selectExpr("CASE WHEN p_size % 5 = 0 THEN ' ' ELSE 's' || CAST(p_partkey AS STRING) END AS sig", "CASE WHEN p_size % 5 = 1 THEN NULL ELSE 'p' END AS purpose")
    valid = part.exceptAll(evaluation.invalid_truth(part))
    done = b.table(spark, sf, "lineitem").where("l_linenumber = 1 AND l_quantity < 25").selectExpr("'s' || CAST(l_partkey AS STRING) AS sig", "CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'b' ELSE 'z' END AS model")
    return evaluation.pending(valid, spark.createDataFrame([("a",), ("b",), ("c",)], "model string"), done)
