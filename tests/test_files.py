"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from trailhead.sources import readers, writers


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_catalog_takes_the_last_category(spark, tmp_path):
    doc = {"metadata": {"total_apis": 9}, "api_categories": {"a": {"severity": "HIGH", "description": "d", "apis": ["<C: void m()>", "<C: int n()>"]}, "b": {"severity": "MEDIUM", "description": "e", "apis": ["<C: void m()>"]}, "c": {"description": "f", "apis": ["<D: void o()>"]}}}
    rows = {r["sig"]: (r["category"], r["severity"]) for r in readers.catalog(spark, put(tmp_path, "c.json", json.dumps(doc))).collect()}
    assert rows == {"<C: void m()>": ("b", "MEDIUM"), "<C: int n()>": ("a", "HIGH"), "<D: void o()>": ("c", "UNKNOWN")}


def test_source_sink_lines(spark, tmp_path):
    text = "% comment\n\n<a.B: java.lang.String get(a.C, int)> -> _SOURCE_  \n<a.B: void put(double,double)> android.permission.X -> _SINK_\n<a.B: both()> -> _BOTH_\n<a.B: int count> -> _SOURCE_\n"
    rows = {r["name"]: r for r in readers.source_sink_text(spark, put(tmp_path, "s.txt", text)).collect()}
    assert (rows["get"]["class"], rows["get"]["ret"], rows["get"]["params"]) == ("a.B", "java.lang.String", ["a.C", "int"])
    assert rows["get"]["is_source"] and not rows["get"]["is_sink"] and rows["put"]["permissions"] == ["android.permission.X"]
    assert rows["both"]["is_source"] and rows["both"]["is_sink"] and rows["both"]["params"] == []
    assert rows["count"]["is_field"] and rows["count"]["params"] is None


def test_source_sink_xml(spark, tmp_path):
    text = """<sinkSources><category id="NET"><method signature="&lt;a.B: void m(int)&gt;"><base type="a.B"><accessPath isSource="false" isSink="true"/></base>
    <param index="0" type="int"><accessPath isSource="true" isSink="false"><pathElement type="T" field="f"/><pathElement type="U" field="g"/></accessPath></param></method></category></sinkSources>"""
    rows = sorted(readers.source_sink_xml(spark, put(tmp_path, "s.xml", text)).collect(), key=lambda r: r["position"])
    assert [(r["category"], r["sig"], r["position"], r["is_source"], r["is_sink"]) for r in rows] == [("NET", "<a.B: void m(int)>", "base", False, True), ("NET", "<a.B: void m(int)>", "param", True, False)]
    assert [e["field"] for e in rows[1]["fields"]] == ["f", "g"] and rows[1]["param_index"] == 0


def test_permission_maps(spark, tmp_path):
    headers = "Permission:android.A\n<a.B: void m()> (x)\n<a.B: void n()>\nPermission:android.C\n<a.B: void m()>\n"
    assert {r["sig"]: r["permissions"] for r in readers.permission_headers(spark, put(tmp_path, "p.txt", headers)).collect()} == {"<a.B: void m()>": ["android.A", "android.C"], "<a.B: void n()>": ["android.A"]}
    table = 'CallerClass,CallerMethod,Permission\na.B,"void m(int,int)",android.A;android.C\n'
    assert readers.permission_csv(spark, put(tmp_path, "p.csv", table)).collect()[0][:] == ("<a.B: void m(int,int)>", ["android.A", "android.C"])


def test_library_summaries(spark, tmp_path):
    text = """<summary fileFormatVersion="102"><hierarchy superClass="java.lang.Object"><interface name="java.util.List"/></hierarchy><methods><method id="void add(T)"><flows>
    <flow isAlias="true" typeChecking="false"><from sourceSinkType="Parameter" ParameterIndex="0"/><to sourceSinkType="Field" AccessPath="[x.L: java.lang.Object[] inner]" AccessPathTypes="[T]"/></flow></flows>
    <clears><clear sourceSinkType="Field" AccessPath="[x.L: T inner]"/></clears></method></methods></summary>"""
    path = put(tmp_path, "x.L.xml", text)
    flow = readers.summary_flows(spark, path).collect()[0]
    assert (flow["class"], flow["method"], flow["is_alias"], flow["type_checking"]) == ("x.L", "void add(T)", True, False)
    assert flow["from"]["kind"] == "Parameter" and flow["to"]["fields"] == ["inner"]
    assert readers.summary_clears(spark, path).collect()[0]["clear"]["fields"] == ["inner"]
    assert {(r["sub"], r["sup"], r["is_interface"]) for r in readers.summary_hierarchy(spark, path).collect()} == {("x.L", "java.lang.Object", False), ("x.L", "java.util.List", True)}
    flows = readers.summary_flows(spark, path)
    assert readers.prioritised(flows, flows.withColumn("is_alias", F.lit(False))).collect()[0]["is_alias"]


def test_lists_manifests_layouts_and_models(spark, tmp_path):
    rows = readers.wrapper_list(spark, put(tmp_path, "w.txt", "# c\n^java.\n~<a.B: void m()>\n-<a.B: void n()>\n<a.B: void o()>\n")).collect()
    assert [(r["kind"], r["entry"]) for r in rows] == [("prefix", "java."), ("exclude", "<a.B: void m()>"), ("kill", "<a.B: void n()>"), ("propagate", "<a.B: void o()>")]
    text = """<manifest package="p"><application><activity android:name="p.A" android:exported="true"><intent-filter><action android:name="go"/></intent-filter></activity>
    <service android:name="p.S" android:enabled="false"></service><receiver android:name="p.R"></receiver></application></manifest>"""
    found = {r["name"]: r for r in readers.manifest(spark, put(tmp_path, "m.xml", text)).collect()}
    assert set(found) == {"p.A", "p.R"} and found["p.A"]["exported"] and found["p.A"]["actions"] == ["go"]
    layout = put(tmp_path, "res/main.xml", '<L><Button a="b" android:onClick="tap"/><include layout="@layout/other"/></L>')
    assert readers.layout_callbacks(spark, layout).collect()[0][1:] == ("Button", "tap")
    assert readers.layout_includes(spark, layout).collect()[0][:] == ("main", "other")
    model = 'name: "de.x"\nversion: 1\ncomponents {\n  name: "de.x.Main"\n  kind: ACTIVITY\n  exported: true\n  intent_filters {\n    attributes {\n      kind: ACTION\n      value: "go"\n    }\n  }\n}\n'
    assert readers.component_models(spark, put(tmp_path, "c.txt", model)).collect()[0][:] == ("de.x", "de.x.Main", "ACTIVITY", True, ["go"])


def test_call_graph_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "c")], "src string, dst string")
    writers.call_graph_json(edges).select("document").write.text(str(tmp_path / "cg"))
    assert writers.same_results(readers.call_graph_json(spark, str(tmp_path / "cg" / "*.txt")), edges)


def test_documents_and_listing(spark, tmp_path):
    results = spark.createDataFrame(
        [("app/1", "m", "net", "HIGH", "success", ["c"], ["x", "y"]), ("app/1", "n", "net", "HIGH", "failed", [], [])],
        "app_id string, sig string, category string, severity string, status string, call_chains array<string>, constraints array<string>",
    )
    writers.write_documents(writers.api_documents(results), str(tmp_path / "out"))
    doc = json.loads(next((tmp_path / "out" / "app_id=app_1").glob("*.txt")).read_text())
    assert (doc["total_dangerous_apis"], doc["successful"], doc["failed"], doc["total_constraints"], doc["apis_by_category"]) == (2, 1, 1, 2, {"net": ["m", "n"]})
    for name, size in (("a", 10), ("b", 100), ("c", 5)):
        put(tmp_path, f"apps/{name}.apk", "x" * size)
    done = spark.createDataFrame([("c",)], "app_id string")
    assert [r["app_id"] for r in readers.batch_listing(spark, str(tmp_path / "apps"), 50, done).collect()] == ["a"]


def test_flow_xml_round_trip(spark, tmp_path):
    flows = spark.createDataFrame([("k", "m", "x.f", "s1", "m", "y"), ("k", "m", "x.f", "s2", "m", "z")], "sink_stmt string, sink_method string, sink_ap string, source_stmt string, source_method string, source_ap string")
    writers.flow_xml(flows, str(tmp_path / "flows"))
    rows = readers.flow_results_xml(spark, str(tmp_path / "flows"))
    assert {tuple(r) for r in rows.collect()} == {("k", "x.f", "s1", "y"), ("k", "x.f", "s2", "z")}


def test_broken_xml_is_noticed(spark, tmp_path):
    with pytest.raises(Exception):
        spark.read.format("xml").option("rowTag", "category").option("mode", "FAILFAST").schema("_id string, method array<string>").load(put(tmp_path, "b.xml", "<category id='a'><method></category>")).collect()


def test_policies_and_categories(spark, tmp_path):
    text = """<policy><assignables><assignable handle="h1"><source><parameter class="a.B" method="get()" parameter="0"/></source></assignable>
    <assignable handle="h2"><sink><parameter class="a.C" method="put(int)" parameter="1"/></sink></assignable></assignables></policy>"""
    rows = readers.rifl(spark, put(tmp_path, "p.xml", text))
    assert {(r["handle"], r["kind"], r["class"], r["member"], r["param"]) for r in rows.collect()} == {("h1", "source", "a.B", "get()", 0), ("h2", "sink", "a.C", "put(int)", 1)}
    writers.policy_xml(rows, str(tmp_path / "out"))
    assert writers.same_results(readers.rifl(spark, str(tmp_path / "out")), rows)
    lines = "<a.B: int get()> (NETWORK)\n<a.B: void put(int)> (LOG)\n"
    found = readers.categorised_text(spark, put(tmp_path, "c.txt", lines), include=["NETWORK"]).collect()
    assert [(r["sig"], r["category"]) for r in found] == [("<a.B: int get()>", "NETWORK")]


def test_reports_and_merging(spark):
    from trailhead.functions import text as t
    from trailhead.operators import appgraph

    item = "struct<kind: string, method: string, variable: string, operator: string, value: string, branch: boolean, text: string>"
    schema = f"path_id string, target string, methods array<string>, constraints array<{item}>, metadata map<string, string>, valid boolean"
    one = lambda value: ("SWITCH", "m", "v", "==", value, True, f"v=={value}")
    rows = [("a", "t", ["x", "t"], [one("1")], {"k": "1", "l": "1"}, True), ("b", "t", ["y", "x", "t"], [one("1"), one("2"), one("1")], {"k": "2"}, True), ("c", "u", ["u"], [], {}, True)]
    paths = spark.createDataFrame(rows, schema)
    pairs = paths.alias("p").join(paths.alias("q"), F.expr("p.path_id = 'a' AND q.path_id <> 'a'"))
    both = lambda n: F.struct(*[F.col(f"{n}.{c}") for c in ("path_id", "target", "methods", "constraints", "metadata")])
    got = {r["other"]: r["m"] for r in pairs.select(F.col("q.path_id").alias("other"), appgraph.merged(both("p"), both("q")).alias("m")).collect()}
    assert got["c"] is None and got["b"]["path_id"] == "a+b" and got["b"]["methods"] == ["x", "t", "y"] and not got["b"]["valid"]
    assert len(got["b"]["constraints"]) == 2 and got["b"]["metadata"] == {"k": "2", "l": "1"}
    text = {r["path_id"]: r["value"] for r in appgraph.described(paths).collect()}
    assert text["b"].splitlines()[:3] == ["Target: t", "Valid: true", "Constraints: (v==1) AND (v==2) AND (v==1)"] and "  2. x" in text["b"]
    sinks = spark.createDataFrame([("y",)], "node string")
    assert [r["path_id"] for r in appgraph.contains_sink(paths.select("path_id", F.col("methods").alias("path")), sinks).collect()] == ["b"]
    row = spark.range(1).select(t.bundle_type(F.lit("putString")), t.bundle_type(F.lit("putExtra")), t.bundle_type(F.lit("get")), t.component_label(F.lit("MyService")), appgraph.cyclic(F.array(F.lit(1), F.lit(1)))).first()
    assert row[:] == ("String", "Object", None, "Service", True)
    table = writers.constraint_csv(paths, "target").where("Method = 't'").first()
    assert table[:] == ("t", 2, 2, 0, 2.0)
    guide = spark.createDataFrame([("p", [("m", [1, 2]), ("n", [1])])], "path_id string, executions array<struct<method: string, blocks: array<int>>>")
    assert writers.guidance(guide).first()["value"] == "{'entry': 'm', 'executions': [('m', 2), ('n', 1)]}"
