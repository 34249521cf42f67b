"""Result documents, exports and reports, written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailhead.functions import text as t


def api_documents(results: DataFrame) -> DataFrame:
    """(app_id, document): the summary of each app as JSON.

    results has a row for each dangerous method: app_id, sig, category, severity, status,
    call_chains (array) and constraints (array). Counters come from the rows themselves.
    """
    detail = F.struct("sig", "category", "severity", "status", F.size("call_chains").alias("n_chains"), F.size("constraints").alias("n_constraints"))
    by_category = results.groupBy("app_id", "category").agg(F.sort_array(F.collect_set("sig")).alias("apis"), F.count("*").alias("n"))
    categories = by_category.groupBy("app_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "apis")))).alias("apis_by_category"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_statistics")
    )
    totals = results.groupBy("app_id").agg(
        F.count("*").alias("total_dangerous_apis"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") != "success").alias("failed"),
        F.sum(F.size("call_chains")).alias("total_chains"), F.sum(F.size("constraints")).alias("total_constraints"), F.array_sort(F.collect_list(detail)).alias("detailed_results"),
    )
    rows = totals.join(categories, "app_id")
    return rows.select("app_id", F.to_json(F.struct(*[c for c in rows.columns if c != "app_id"])).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One folder for each app. Its name is safe on every file system; of apps whose names become alike by that, each has a hash behind it."""
    safe = t.safe_name("app_id")
    rows = documents.withColumn("alike", F.count("*").over(Window.partitionBy(safe)))
    name = F.when(F.col("alike") > 1, F.concat(safe, F.lit("-"), F.substring(F.sha2("app_id", 256), 1, 8))).otherwise(safe)
    rows.select(name.alias("app_id"), F.col("document").alias("value")).write.partitionBy("app_id").mode("append").text(path)


def batch_summary(results: DataFrame) -> DataFrame:
    """One row of totals over all apps."""
    return results.agg(
        F.count_distinct("app_id").alias("apps"), F.count("*").alias("apis"), F.count_if(F.col("status") == "success").alias("successful"),
        F.coalesce(F.sum(F.size("call_chains")), F.lit(0)).alias("chains"), F.coalesce(F.sum(F.size("constraints")), F.lit(0)).alias("constraints"),
    )


def report(results: DataFrame) -> DataFrame:
    """(app_id, value): a readable block for each method."""
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Method: "), "sig"), F.concat(F.lit("Category: "), "category", F.lit(" ("), "severity", F.lit(")")), F.concat(F.lit("Status: "), "status"),
        F.concat(F.lit("Call chains: "), F.size("call_chains").cast("string")), F.concat(F.lit("Constraints: "), F.size("constraints").cast("string")),
    )
    return results.select("app_id", lines.alias("value"))


def call_graph_json(edges: DataFrame) -> DataFrame:
    """(src, document): one JSON line for each caller with its sorted callees."""
    rows = edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("callees"))
    return rows.select("src", F.to_json(F.create_map("src", "callees")).alias("document"))


def dot(edges: DataFrame, name: str = "G") -> DataFrame:
    """(part, value): lines of a DOT graph; in order of part and value they make up the file."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = edges.select(F.lit(1).alias("part"), F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";")).alias("value")).distinct()
    ends = edges.sparkSession.createDataFrame([(0, f"digraph {name} {{"), (2, "}")], "part int, value string")
    return body.unionByName(ends)


def gexf(edges: DataFrame) -> DataFrame:
    """(part, value): lines of a GEXF document."""
    node = edges.select(F.explode(F.array("src", "dst")).alias("n")).select(F.col("n").cast("string").alias("n")).distinct()
    nodes = node.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), t.xml_escaped("n"), F.lit('" label="'), t.xml_escaped("n"), F.lit('"/>')).alias("value"))
    links = edges.select(F.lit(3).alias("part"), F.concat(F.lit('<edge source="'), t.xml_escaped(F.col("src").cast("string")), F.lit('" target="'), t.xml_escaped(F.col("dst").cast("string")), F.lit('"/>')).alias("value")).distinct()
    frame = [(0, '<gexf version="1.2"><graph defaultedgetype="directed"><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")]
    return nodes.unionByName(links).unionByName(edges.sparkSession.createDataFrame(frame, "part int, value string"))


def flow_xml(flows: DataFrame, path: str) -> None:
    """Flow results as XML: a Result element for each sink with all its sources."""
    end = lambda p: F.struct(F.col(f"{p}_stmt").alias("_Statement"), F.col(f"{p}_method").alias("_Method"), F.struct(F.col(f"{p}_ap").alias("_Value")).alias("AccessPath"))
    rows = flows.groupBy("sink_stmt", "sink_method", "sink_ap").agg(F.sort_array(F.collect_set(end("source"))).alias("sources"))
    rows.select(end("sink").alias("Sink"), F.struct(F.col("sources").alias("Source")).alias("Sources")).write.format("xml").option("rowTag", "Result").option("rootTag", "DataFlowResults").mode("overwrite").save(path)


def summary_xml(flows: DataFrame, path: str, clears: DataFrame | None = None, edges: DataFrame | None = None) -> None:
    """Summary flows (class, method, from, to, is_alias) as XML, a folder for each class.

    clears (class, method, clear) are what methods empty, with or without flows; edges (sub, sup,
    is_interface) become a document of the class's hierarchy, with the least of several superclasses.
    """
    def end(df, c):
        has = df.schema[c].dataType.fieldNames()
        path_ = F.concat(F.lit("["), F.array_join(F.transform(F.col(c)["fields"], lambda x: F.concat(F.lit("x: y "), x)), ", "), F.lit("]"))
        more = [F.col(c)[name].alias(as_) for name, as_ in (("gap", "_gap"), ("base_type", "_BaseType"), ("match_strict", "_matchStrict")) if name in has]
        return F.struct(F.col(c)["kind"].alias("_sourceSinkType"), F.col(c)["param"].alias("_ParameterIndex"), path_.alias("_AccessPath"), *more)

    flow = F.struct(F.col("is_alias").alias("_isAlias"), end(flows, "from").alias("from"), end(flows, "to").alias("to"))
    rows = flows.groupBy("class", "method").agg(F.struct(F.collect_list(flow).alias("flow")).alias("flows"))
    if clears is not None:
        rows = rows.join(clears.groupBy("class", "method").agg(F.struct(F.collect_list(end(clears, "clear")).alias("clear")).alias("clears")), ["class", "method"], "full")
    rows = rows.withColumnRenamed("method", "_id")
    rows.write.partitionBy("class").format("xml").option("rowTag", "method").option("rootTag", "methods").mode("overwrite").save(path)
    if edges is not None:
        above = F.min(F.when(~F.col("is_interface"), F.col("sup"))).alias("_superClass")
        named = F.array_sort(F.collect_set(F.when(F.col("is_interface"), F.col("sup"))))
        made = edges.groupBy(F.col("sub").alias("class")).agg(above, F.transform(named, lambda x: F.struct(x.alias("_name"))).alias("interface"))
        made.write.partitionBy("class").format("xml").option("rowTag", "hierarchy").option("rootTag", "summary").mode("append").save(path)


def same_results(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def guidance(paths: DataFrame) -> DataFrame:
    """(path_id, value): literal text that guides a symbolic executor: entry, methods and their block counts."""
    blocks = F.array_join(F.transform("executions", lambda e: F.concat(F.lit("('"), e["method"].cast("string"), F.lit("', "), F.size(e["blocks"]).cast("string"), F.lit(")"))), ", ")
    return paths.select("path_id", F.concat(F.lit("{'entry': '"), F.col("executions")[0]["method"].cast("string"), F.lit("', 'executions': ["), blocks, F.lit("]}")).alias("value"))


def policy_xml(assignables: DataFrame, path: str) -> None:
    """A policy document of assignables (handle, kind, class, member, param)."""
    place = F.struct(F.col("class").alias("_class"), F.col("member").alias("_method"), F.col("param").cast("string").alias("_parameter"))
    rows = assignables.groupBy("handle").agg(
        F.collect_list(F.when(F.col("kind") == "source", F.struct(place.alias("parameter")))).alias("source"), F.collect_list(F.when(F.col("kind") == "sink", F.struct(place.alias("parameter")))).alias("sink")
    )
    rows.select(F.col("handle").alias("_handle"), "source", "sink").write.format("xml").option("rowTag", "assignable").option("rootTag", "assignables").mode("overwrite").save(path)


def log_documents(interactions: DataFrame) -> DataFrame:
    """(session, value): one JSON line for each interaction of a session, in order of time."""
    return interactions.select("session", F.to_json(F.struct(*[c for c in interactions.columns if c != "session"])).alias("value"))


def constraint_csv(paths: DataFrame, target: str) -> DataFrame:
    """Method, Total, Valid, Invalid and AvgConstraints of each target of paths (valid, constraints)."""
    made = paths.groupBy(F.col(target).alias("Method")).agg(
        F.count("*").alias("Total"), F.count_if("valid").alias("Valid"), F.count_if(~F.col("valid")).alias("Invalid"), F.round(F.avg(F.size("constraints")), 2).alias("AvgConstraints")
    )
    return made


def control_flow_view(stmts: DataFrame) -> DataFrame:
    """(method, value): a readable view of each method of statements (method, ordinal, kind, is_sink): its units with entry, exit and sink calls marked."""
    unit = F.struct("ordinal", "kind", F.coalesce("is_sink", F.lit(False)).alias("is_sink"))
    rows = stmts.groupBy("method").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    mark = lambda hit, word: F.when(hit, F.lit(f" ({word})")).otherwise("")
    line = lambda u, i: F.concat(
        F.lit("  ["), u["ordinal"].cast("string"), F.lit("] "), u["kind"], mark(i == 0, "entry"), mark(i == F.size("units") - 1, "exit"), mark(u["is_sink"], "sink")
    )
    head = F.concat(F.lit("Method m"), F.col("method").cast("string"), F.lit(": "), F.size("units").cast("string"), F.lit(" units\n"))
    return rows.select("method", F.concat(head, F.array_join(F.transform("units", line), "\n")).alias("value"))


def path_event_documents(rows: DataFrame) -> DataFrame:
    """(class, document): methods, their paths and the events of each as JSON, from rows (class, method, path, ordinal, kind)."""
    events = rows.groupBy("class", "method", "path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind"))).alias("events"))
    paths = events.groupBy("class", "method").agg(F.array_sort(F.collect_list(F.struct("path", "events"))).alias("paths"))
    methods = paths.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("method", "paths"))).alias("methods"))
    return methods.select("class", F.to_json(F.struct("methods")).alias("document"))


def evaluation_documents(rows: DataFrame) -> DataFrame:
    """(model, document): the report of each model as JSON, from rows (model, category, score, ok)."""
    each = rows.groupBy("model", "category").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.avg(F.when(F.col("ok"), F.col("score"))).alias("mean"), F.max("score").alias("best"))
    entry = F.struct("category", F.struct("n", "ok", "mean").alias("v"))
    made = each.groupBy("model").agg(F.sum("n").alias("evaluated"), F.sum("ok").alias("successful"), F.max("best").alias("best"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_category"))
    return made.select("model", F.to_json(F.struct("evaluated", "successful", "best", "by_category")).alias("document"))


def evaluation_csv(rows: DataFrame, path: str) -> None:
    """The same figures as a table, a row for each model and category."""
    rows.groupBy("model", "category").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.avg(F.when(F.col("ok"), F.col("score"))).alias("mean")).write.mode("overwrite").option("header", True).csv(path)


def kept_files(files: DataFrame, name: str) -> DataFrame:
    """Of files (path) those of one name, of each folder; nothing is deleted."""
    return files.where(F.element_at(F.split("path", "/"), -1) == name)
