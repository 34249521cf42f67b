"""Readers of specification files and result documents into tables.

All files are read through Spark's own readers (text, csv, json, xml, binary), so any
file system that Spark knows will do. Signatures in files are given as
``<class: ret name(p1,p2)>``; lists use exact equality unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailhead.operators import recursion

# Patterns of a source/sink line: a method with, a method without a return type, a field.
METHOD_LINE = r"^<(.+):\s*(.+)\s+(.+)\s*\((.*)\)>\s*(.*?)(\s+->\s+(.*))?$"
NO_RETURN_LINE = r"^<(.+):\s*(.+)\s*\((.*)\)>\s*(.*?)?(\s+->\s+(.*))?$"
FIELD_LINE = r"^<(.+):\s*(.+)\s+([a-zA-Z_$][a-zA-Z_$0-9]*)\s*>\s*(.*?)(\s+->\s+(.*))?$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of text files, which Spark may split among tasks."""
    return spark.read.text(path).select(F.trim("value").alias("line"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, each read whole so that line numbers exist; for small files."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim("line"))


def _params(text) -> F.Column:
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(text), r"\s*,\s*"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(category, severity, description, sig) of an API catalog in one or more documents; of a signature in several categories the last one counts."""
    text = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    kind = "struct<api_categories: map<string, struct<description: string, severity: string, apis: array<string>>>>"
    entries = text.select("file", F.map_entries(F.from_json("value", kind)["api_categories"]).alias("e")).select("file", F.posexplode("e").alias("at", "e"))
    rows = entries.select(F.struct("file", "at").alias("at"), F.col("e.key").alias("category"), "e.value.severity", "e.value.description", F.explode("e.value.apis").alias("sig"))
    last = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("at")))
    return rows.withColumn("rank", last).where("rank = 1").select("category", F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"), "description", "sig")


def source_sink_text(spark: SparkSession, path: str) -> DataFrame:
    """(class, ret, name, params, is_field, permissions, is_source, is_sink); blank lines and lines with % are skipped."""
    rows = _lines(spark, path).where("line <> '' AND NOT startswith(line, '%')")
    line = F.col("line")
    method, plain, field = (line.rlike(p) for p in (METHOD_LINE, NO_RETURN_LINE, FIELD_LINE))

    def pick(m, n, f):
        part = lambda pattern, group: F.regexp_extract(line, pattern, group)
        none = F.lit(None).cast("string")
        return F.when(method, part(METHOD_LINE, m)).when(plain, part(NO_RETURN_LINE, n) if n else none).when(field, part(FIELD_LINE, f) if f else none)

    # the arrow and what stands before it are taken apart here, as the patterns leave a line without permissions open
    target = F.regexp_extract(line, r"->\s*(\S.*)$", 1)
    permissions = F.regexp_extract(F.substring_index(line, "->", 1), r">\s*([^>]*)$", 1)
    return rows.where(method | plain | field).select(
        F.trim(pick(1, 1, 1)).alias("class"), pick(2, 0, 2).alias("ret"), F.trim(pick(3, 2, 3)).alias("name"),
        F.when(method | plain, _params(pick(4, 3, 0))).alias("params"), (~method & ~plain).alias("is_field"),
        F.filter(F.split(permissions, r"\s+"), lambda x: x != "").alias("permissions"),
        (F.contains(target, F.lit("_SOURCE_")) | F.contains(target, F.lit("_BOTH_"))).alias("is_source"), (F.contains(target, F.lit("_SINK_")) | F.contains(target, F.lit("_BOTH_"))).alias("is_sink"),
    )


def categorised_text(spark: SparkSession, path: str, include: list[str] | None = None, source: bool = True) -> DataFrame:
    """(sig, category, is_source) of lines that end with their category in parentheses."""
    rows = _lines(spark, path)
    found = rows.select(F.regexp_extract("line", r"^(<[^>]+(?:>\(.*\))?[^>]*>)", 1).alias("sig"), F.regexp_extract("line", r"\(([A-Z_]+)\)\s*$", 1).alias("category")).where("sig <> '' AND category <> ''")
    found = found if include is None else found.where(F.col("category").isin(*include))
    return found.withColumn("is_source", F.lit(source))


def permission_csv(spark: SparkSession, path: str) -> DataFrame:
    """(sig, permissions) of a table with the columns class, method and a list of permissions."""
    rows = spark.read.option("header", True).option("quote", '"').csv(path).toDF("class", "method", "permissions")
    return rows.select(F.concat(F.lit("<"), "class", F.lit(": "), "method", F.lit(">")).alias("sig"), F.filter(F.split(F.coalesce("permissions", F.lit("")), r"[,;\s]+"), lambda x: x != "").alias("permissions"))


def permission_headers(spark: SparkSession, path: str) -> DataFrame:
    """(sig, permissions): callers below the "Permission:" line that they belong to."""
    header = F.when(F.col("line").startswith("Permission:"), F.trim(F.expr("substring(line, 12)")))
    order = Window.partitionBy("file").orderBy("line_no")
    rows = _numbered_lines(spark, path).withColumn("permission", F.last(header, ignorenulls=True).over(order))
    found = rows.where("startswith(line, '<') AND permission IS NOT NULL").select(F.regexp_extract("line", r"^(<.*>)", 1).alias("sig"), "permission")
    return found.groupBy("sig").agg(F.sort_array(F.collect_set("permission")).alias("permissions"))


_ELEMENT = "struct<_type: string, _field: string>"
_PATH = f"struct<_isSource: boolean, _isSink: boolean, pathElement: array<{_ELEMENT}>>"
_POSITION = f"struct<_type: string, _index: int, accessPath: array<{_PATH}>>"
_CATEGORY = f"_id string, method array<struct<_signature: string, base: array<{_POSITION}>, `return`: array<{_POSITION}>, param: array<{_POSITION}>>>"


def source_sink_xml(spark: SparkSession, path: str) -> DataFrame:
    """(category, sig, position, param_index, type, is_source, is_sink, fields): a row for each access path."""
    rows = spark.read.format("xml").option("rowTag", "category").schema(_CATEGORY).load(path).select(F.col("_id").alias("category"), F.explode("method").alias("m"))
    parts = [
        rows.select("category", F.col("m._signature").alias("sig"), F.lit(name).alias("position"), F.explode(F.col("m")[name]).alias("p")) for name in ("base", "return", "param")
    ]
    each = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("*", F.explode("p.accessPath").alias("a"))
    return each.select(
        "category", "sig", "position", F.col("p._index").alias("param_index"), F.col("p._type").alias("type"), F.col("a._isSource").alias("is_source"), F.col("a._isSink").alias("is_sink"),
        F.transform(F.coalesce("a.pathElement", F.array().cast(f"array<{_ELEMENT}>")), lambda e: F.struct(e["_field"].alias("field"), e["_type"].alias("type"))).alias("fields"),
    )


def rifl(spark: SparkSession, path: str) -> DataFrame:
    """(handle, kind, class, method, param): every assignable of a policy counts, whatever its domain."""
    place = "struct<_class: string, _method: string, _field: string, _parameter: string>"
    side = f"array<struct<parameter: {place}, returnvalue: {place}, field: {place}>>"
    rows = spark.read.format("xml").option("rowTag", "assignable").schema(f"_handle string, source {side}, sink {side}").load(path)
    both = rows.select(F.col("_handle").alias("handle"), F.lit("source").alias("kind"), F.explode("source").alias("p")).unionByName(rows.select(F.col("_handle").alias("handle"), F.lit("sink").alias("kind"), F.explode("sink").alias("p")))
    at = F.coalesce("p.parameter", "p.returnvalue", "p.field")
    return both.select("handle", "kind", at["_class"].alias("class"), F.coalesce(at["_method"], at["_field"]).alias("member"), at["_parameter"].cast("int").alias("param"))


_END = "struct<_sourceSinkType: string, _ParameterIndex: int, _AccessPath: string, _AccessPathTypes: string, _BaseType: string, _gap: int, _taintSubFields: boolean, _matchStrict: boolean, _constrained: string>"
_FLOW = f"array<struct<_isAlias: boolean, _typeChecking: boolean, _cutSubfields: boolean, `from`: {_END}, `to`: {_END}>>"
_METHOD = f"_id string, _isExcluded boolean, flows struct<flow: {_FLOW}>, clears struct<clear: array<{_END}>>"


def _class_of_file() -> F.Column:
    """The class that a file is named after, or the folder that ``writers.summary_xml`` put it in."""
    folder = F.nullif(F.regexp_extract(F.input_file_name(), r"/class=([^/]+)/[^/]*$", 1), F.lit(""))
    return F.coalesce(F.url_decode(folder), F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.xml$", ""))


def _endpoint(e) -> F.Column:
    fields = F.regexp_extract_all(F.coalesce(e["_AccessPath"], F.lit("")), F.lit(r":\s*\S+\s+([\w$]+)"), 1)
    return F.struct(
        e["_sourceSinkType"].alias("kind"), e["_ParameterIndex"].alias("param"), fields.alias("fields"), e["_BaseType"].alias("base_type"), e["_gap"].alias("gap"),
        F.coalesce(e["_taintSubFields"], F.lit(False)).alias("taint_sub"), F.coalesce(e["_matchStrict"], F.lit(False)).alias("match_strict"), e["_constrained"].alias("constrained"),
    )


def summary_flows(spark: SparkSession, path: str) -> DataFrame:
    """(class, method, from, to, is_alias, type_checking, cut_subfields) of library summaries, one file for each class."""
    rows = spark.read.format("xml").option("rowTag", "method").schema(_METHOD).load(path).select(_class_of_file().alias("class"), F.col("_id").alias("method"), F.explode("flows.flow").alias("f"))
    return rows.select(
        "class", "method", _endpoint(F.col("f.from")).alias("from"), _endpoint(F.col("f.to")).alias("to"), F.coalesce("f._isAlias", F.lit(False)).alias("is_alias"),
        F.coalesce("f._typeChecking", F.lit(True)).alias("type_checking"), F.coalesce("f._cutSubfields", F.lit(False)).alias("cut_subfields"),
    )


def summary_clears(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "method").schema(_METHOD).load(path).select(_class_of_file().alias("class"), F.col("_id").alias("method"), F.explode("clears.clear").alias("c"))
    return rows.select("class", "method", _endpoint(F.col("c")).alias("clear"))


def summary_constraints(spark: SparkSession, path: str) -> DataFrame:
    """(class, method, kind, source_sink_type, param, implicit_location): which argument or place names the index or key that a method's flows are bound to."""
    place = "array<struct<_sourceSinkType: string, _ParameterIndex: int, _ImplicitLocation: string>>"
    rows = spark.read.format("xml").option("rowTag", "method").schema(f"_id string, constraints struct<index: {place}, key: {place}>").load(path).select(_class_of_file().alias("class"), F.col("_id").alias("method"), "constraints")
    each = None
    for kind in ("index", "key"):
        made = rows.select("class", "method", F.lit(kind).alias("kind"), F.explode(F.col("constraints")[kind]).alias("c"))
        each = made if each is None else each.unionByName(made)
    return each.select("class", "method", "kind", F.col("c._sourceSinkType").alias("source_sink_type"), F.col("c._ParameterIndex").alias("param"), F.col("c._ImplicitLocation").alias("implicit_location"))


def summary_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """(sub, sup, is_interface)."""
    named = "struct<_name: string>"
    schema = f"_superClass string, interface array<{named}>"
    rows = spark.read.format("xml").option("rowTag", "hierarchy").schema(schema).load(path).select(_class_of_file().alias("sub"), "_superClass", "interface")
    above = rows.where("_superClass IS NOT NULL").select("sub", F.col("_superClass").alias("sup"), F.lit(False).alias("is_interface"))
    return above.unionByName(rows.select("sub", F.explode("interface").alias("i")).select("sub", F.col("i._name").alias("sup"), F.lit(True).alias("is_interface")))


def prioritised(*providers: DataFrame) -> DataFrame:
    """Summaries of the first provider that knows a method."""
    rows = None
    for i, p in enumerate(providers):
        p = p.withColumn("prio", F.lit(i))
        rows = p if rows is None else rows.unionByName(p)
    best = F.min("prio").over(Window.partitionBy("class", "method"))
    return rows.withColumn("best", best).where("prio = best").drop("prio", "best")


def wrapper_list(spark: SparkSession, path: str) -> DataFrame:
    """(kind, entry): # comments; ~ excluded, - killing, ^ class prefix; plain lines propagate."""
    line = F.col("line")
    kind = F.when(line.startswith("~"), "exclude").when(line.startswith("-"), "kill").when(line.startswith("^"), "prefix").otherwise("propagate")
    rows = _lines(spark, path).where("line <> '' AND NOT startswith(line, '#')")
    return rows.select(kind.alias("kind"), F.trim(F.regexp_replace(line, r"^[~^-]", "")).alias("entry"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """One name for each line."""
    return _lines(spark, path).where("line <> '' AND NOT startswith(line, '#')").select(F.col("line").alias("name")).distinct()


def call_graph_json(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """(src, dst) of an adjacency document; by_line where each line is a document, so that files can be split."""
    rows = spark.read.text(path) if by_line else spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\{)")).alias("value"))
    rows = rows.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("src", "callees"))
    return rows.select("src", F.explode("callees").alias("dst"))


RESULT = """total_dangerous_apis int, category_statistics map<string,int>, analysis_timestamp string, apis_by_category map<string,array<string>>,
 detailed_results array<struct<method_signature string, api_category string, severity_level string, analysis_status string, analysis_error_message string,
 call_chains array<struct<chain_id string, entry_point string, method_sequence array<string>, path_type string, is_reachable boolean>>,
 constraints_found array<struct<constraint_id string, associated_call_chain string, boolean_logic_format string, business_context_format string, technical_details_format string, constraint_complexity int>>,
 analysis_metrics struct<analysis_start_time bigint, analysis_duration_ms bigint, call_chains_discovered int, constraints_extracted int>>>"""


def result_documents(spark: SparkSession, path: str) -> DataFrame:
    """Prior result documents, with the folder that each stands in as app_id."""
    rows = spark.read.schema(RESULT).option("multiLine", True).json(path)
    return rows.withColumn("app_id", F.element_at(F.split(F.input_file_name(), "/"), -2))


def result_records(spark: SparkSession, path: str) -> DataFrame:
    """Prior results with an app's document in each line and its app_id in the document: many apps to a file."""
    return spark.read.schema(f"app_id string, {RESULT}").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, exported, enabled, actions) of the components of text manifests."""
    filters = "array<struct<action: array<struct<`_android:name`: string>>>>"
    schema = f"`_android:name` string, `_android:exported` string, `_android:enabled` string, `intent-filter` {filters}"
    made = None
    for tag in ("activity", "service", "receiver", "provider"):
        rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        names = F.transform(F.flatten(F.transform(F.coalesce("intent-filter", F.array().cast(filters)), lambda f: f["action"])), lambda a: a["_android:name"])
        rows = rows.select(
            F.lit(tag).alias("kind"), F.col("`_android:name`").alias("name"), F.col("`_android:exported`").cast("boolean").alias("exported"),
            F.coalesce(F.col("`_android:enabled`").cast("boolean"), F.lit(True)).alias("enabled"), names.alias("actions"),
        )
        made = rows if made is None else made.unionByName(rows)
    return made.where("enabled")


def layout_callbacks(spark: SparkSession, path: str) -> DataFrame:
    """(file, view, method) of views that name a click handler in text layouts."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.explode(F.regexp_extract_all("value", F.lit(r"(<[\w.]+[^>]*android:onClick=\"[^\"]+\"[^>]*>)"), 1)).alias("tag"))
    return rows.select("file", F.regexp_extract("tag", r"^<([\w.]+)", 1).alias("view"), F.regexp_extract("tag", r'android:onClick="([^"]+)"', 1).alias("method"))


def layout_includes(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst): which layout includes which, by name."""
    rows = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([\w-]+)\.xml$", 1)
    return rows.select(name.alias("src"), F.explode(F.regexp_extract_all("value", F.lit(r'<include[^>]*layout="@layout/(\w+)"'), 1)).alias("dst"))


def component_models(spark: SparkSession, path: str) -> DataFrame:
    """(package, name, kind, exported, actions) of component models in protobuf text."""
    rows = spark.read.text(path, wholetext=True)
    package = F.regexp_extract("value", r'(?m)^name: "([^"]+)"', 1)
    parts = F.split("value", r"(?m)^components \{")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    each = rows.select(package.alias("package"), F.explode(parts).alias("c"))
    return each.select(
        "package", F.regexp_extract("c", r'name: "([^"]+)"', 1).alias("name"), F.regexp_extract("c", r"\n\s*kind: (ACTIVITY|SERVICE|RECEIVER|PROVIDER)", 1).alias("kind"),
        F.contains("c", F.lit("exported: true")).alias("exported"), F.regexp_extract_all(F.split("c", r"(?m)^\s*exit_points \{")[0], F.lit(r'kind: ACTION\s+value: "([^"]+)"'), 1).alias("actions"),
    )


def flow_results_xml(spark: SparkSession, path: str) -> DataFrame:
    """(sink_stmt, sink_ap, source_stmt, source_ap) of flow result documents."""
    end = "struct<_Statement: string, _Method: string, AccessPath: struct<_Value: string, _Type: string>>"
    schema = f"Sink {end}, Sources struct<Source: array<{end}>>"
    rows = spark.read.format("xml").option("rowTag", "Result").schema(schema).load(path).select("Sink", F.explode("Sources.Source").alias("s"))
    return rows.select(F.col("Sink._Statement").alias("sink_stmt"), F.col("Sink.AccessPath._Value").alias("sink_ap"), F.col("s._Statement").alias("source_stmt"), F.col("s.AccessPath._Value").alias("source_ap"))


def batch_listing(spark: SparkSession, path: str, most_bytes: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """(app_id, path, length) of packages to analyse: those below the size limit that have no result yet. Contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.apk").load(path).select("path", "length")
    rows = rows.withColumn("app_id", F.regexp_extract("path", r"([^/]+)\.apk$", 1))
    rows = rows if most_bytes is None else rows.where(F.col("length") <= most_bytes)
    return rows if done is None else rows.join(done.select("app_id"), "app_id", "left_anti")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(category, sig, purpose, return_type, return_description)."""
    entry = "struct<signature: string, purpose_behavior: string, return_values: struct<type: string, description: string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<framework_methods: map<string, array<{entry}>>>")["framework_methods"]).alias("category", "methods"))
    return rows.select("category", F.explode("methods").alias("m")).select(
        "category", F.col("m.signature").alias("sig"), F.col("m.purpose_behavior").alias("purpose"), F.col("m.return_values.type").alias("return_type"), F.col("m.return_values.description").alias("return_description")
    )


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """A table such as the callbacks found, from path if it is there, else made and written first.

    Spark moves finished files into place and marks the folder with _SUCCESS last; a folder without it is written anew.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def source_sink_conditions(spark: SparkSession, path: str) -> DataFrame:
    """(category, sig, nr, signatures, class_names, excluded): the conditions of definitions; one that names nothing is left out.

    A definition holds if any of its conditions does, and a condition if something of it is on the path.
    """
    named = lambda tag, name: f"{tag}: array<struct<_{name}: string>>"
    condition = f"struct<{named('signatureOnPath', 'signature')}, {named('classNameOnPath', 'className')}, {named('excludeClassName', 'className')}>"
    schema = f"_id string, method array<struct<_signature: string, additionalFlowCondition: array<{condition}>>>"
    rows = spark.read.format("xml").option("rowTag", "category").schema(schema).load(path).select(F.col("_id").alias("category"), F.explode("method").alias("m"))
    each = rows.select("category", F.col("m._signature").alias("sig"), F.posexplode("m.additionalFlowCondition").alias("nr", "c"))
    values = lambda tag, name: F.coalesce(F.transform(F.col("c")[tag], lambda x: x[f"_{name}"]), F.array().cast("array<string>"))
    made = each.select("category", "sig", "nr", values("signatureOnPath", "signature").alias("signatures"), values("classNameOnPath", "className").alias("class_names"), values("excludeClassName", "className").alias("excluded"))
    return made.where((F.size("signatures") > 0) | (F.size("class_names") > 0))


def layout_elements(spark: SparkSession, path: str, layout=None) -> DataFrame:
    """(layout, kind, name, id, method) of text layouts: kind is view, fragment (name is its class) or include (name is the layout).

    A layout is called by its file unless the column layout says otherwise; comments are skipped.
    """
    layout = F.regexp_extract(F.input_file_name(), r"([\w-]+)\.xml$", 1) if layout is None else layout
    text = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    tags = spark.read.text(path, wholetext=True).select(layout.alias("layout"), F.explode(F.regexp_extract_all(text, F.lit(r"<([\w.]+(?:\s+[\w:]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*/?>"), 1)).alias("tag"))
    attribute = lambda name: F.nullif(F.regexp_extract("tag", rf"\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    tag = F.regexp_extract("tag", r"^([\w.]+)", 1)
    kind = F.when(tag == "include", "include").when(tag == "fragment", "fragment").otherwise("view")
    of = F.coalesce(F.when(tag == "include", F.regexp_replace(attribute("layout"), "^@layout/", "")).when(tag == "fragment", F.coalesce(attribute("android:name"), attribute("class"))), tag)
    return tags.select("layout", kind.alias("kind"), of.alias("name"), F.regexp_replace(attribute("android:id"), r"^@\+?(?:android:)?id/", "").alias("id"), attribute("android:onClick").alias("method"))


def resolved_layouts(elements: DataFrame) -> DataFrame:
    """(layout, owner, kind, name, id, method): the elements of a layout and of all that it includes, which may include each other; owner has them."""
    includes = elements.where("kind = 'include'").select(F.col("layout").alias("src"), F.col("name").alias("dst"))
    held = elements.select("layout").distinct().select("layout", F.col("layout").alias("owner"))
    below = recursion.closure(includes).where("src <> dst").select(F.col("src").alias("layout"), F.col("dst").alias("owner"))
    return held.unionByName(below).join(elements.where("kind <> 'include'").withColumnRenamed("layout", "owner"), "owner").select("layout", "owner", "kind", "name", "id", "method")


def manifest_facts(spark: SparkSession, path: str) -> DataFrame:
    """(package, application, min_sdk, target_sdk, permissions) of text manifests; the application's class with its package, permissions sorted."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)<!--.*?-->", "").alias("value"))
    inside = lambda tag, name: F.nullif(F.regexp_extract("value", rf"(?s)<{tag}\b[^>]*?\s{name}\s*=\s*\"([^\"]*)\"", 1), F.lit(""))
    package, application = inside("manifest", "package"), inside("application", "android:name")
    full = F.when(application.startswith("."), F.concat(package, application)).when(~F.contains(application, F.lit(".")), F.concat_ws(".", package, application)).otherwise(application)
    uses = F.array_sort(F.array_distinct(F.regexp_extract_all("value", F.lit(r"(?s)<uses-permission(?:-sdk-23)?\b[^>]*?android:name\s*=\s*\"([^\"]*)\""), 1)))
    return text.select(package.alias("package"), full.alias("application"), inside("uses-sdk", "android:minSdkVersion").cast("int").alias("min_sdk"), inside("uses-sdk", "android:targetSdkVersion").cast("int").alias("target_sdk"), uses.alias("permissions"))


def component_exits(spark: SparkSession, path: str) -> DataFrame:
    """(package, name, method, stmt, kind, action, class) of the exit points of component models in protobuf text: a row for each intent."""
    rows = spark.read.text(path, wholetext=True)
    after = lambda text, mark: F.slice(F.split(text, mark), 2, 1 << 30)
    each = rows.select(F.regexp_extract("value", r'(?m)^name: "([^"]+)"', 1).alias("package"), F.explode(after(F.col("value"), r"(?m)^components \{")).alias("c"))
    exits = each.select("package", F.regexp_extract("c", r'name: "([^"]+)"', 1).alias("name"), F.explode(after(F.col("c"), r"(?m)^\s*exit_points \{")).alias("e"))
    head = F.split("e", r"(?m)^\s*intents \{")[0]
    found = exits.select(
        "package", "name", F.regexp_extract("e", r'method: "([^"]*)"', 1).alias("method"), F.regexp_extract("e", r"\bid: (\d+)", 1).cast("long").alias("stmt"),
        F.regexp_extract(head, r"\bkind: (ACTIVITY|SERVICE|RECEIVER|PROVIDER)", 1).alias("kind"), F.explode(after(F.col("e"), r"(?m)^\s*intents \{")).alias("i"),
    )
    value = lambda kind: F.nullif(F.regexp_extract("i", rf'kind: {kind}\s+value: "([^"]*)"', 1), F.lit(""))
    return found.select("package", "name", "method", "stmt", "kind", value("ACTION").alias("action"), F.replace(value("CLASS"), F.lit("/"), F.lit(".")).alias("class"))


def component_links(exits: DataFrame, models: DataFrame) -> DataFrame:
    """(package, name, stmt, target, explicit): components of the same app that an exit may start: the class that it names, else those of its kind with a filter for its action."""
    named = exits.where("class IS NOT NULL").join(models.select("package", F.col("name").alias("class")).distinct(), ["package", "class"]).select("package", "name", "stmt", F.col("class").alias("target"), F.lit(True).alias("explicit"))
    filters = models.select("package", "kind", F.explode(F.array_distinct("actions")).alias("action"), F.col("name").alias("target"))
    open_ = exits.where("class IS NULL AND action IS NOT NULL").join(filters, ["package", "kind", "action"]).select("package", "name", "stmt", "target", F.lit(False).alias("explicit"))
    return named.unionByName(open_).distinct()
