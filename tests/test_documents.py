"""Readers of whole documents: what is absent, in circles or commented out."""

from trailhead.sources import readers


def _file(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_layouts_that_include_each_other(spark, tmp_path):
    _file(tmp_path, "a.xml", "<LinearLayout><include layout='@layout/b'/><!-- <Button android:id=\"@+id/gone\"/> --><Button android:id=\"@+id/one\"\n android:onClick=\"go\"/></LinearLayout>")
    _file(tmp_path, "b.xml", '<merge><include layout="@layout/a"/><include layout="@layout/absent"/><fragment class="c.F"/><TextView android:id="@android:id/text"/></merge>')
    _file(tmp_path, "c.xml", "")
    elements = readers.layout_elements(spark, str(tmp_path))
    own = {"a": {("LinearLayout", None, None), ("Button", "one", "go")}, "b": {("merge", None, None), ("c.F", None, None), ("TextView", "text", None)}}
    rows = readers.resolved_layouts(elements).collect()
    assert {(r.layout, r.owner, r.name, r.id, r.method) for r in rows} == {(x, y, *e) for x in "ab" for y in "ab" for e in own[y]}
    assert {r.kind for r in rows if r.name == "c.F"} == {"fragment"}


def test_manifests(spark, tmp_path):
    _file(tmp_path, "full.xml", '<manifest package="com.a"><uses-permission android:name="P2"/><uses-permission-sdk-23 android:name="P1"/><uses-permission android:name="P2"/><application android:name="App"></application></manifest>')
    _file(tmp_path, "bare.xml", "<manifest><!-- <uses-permission android:name=\"no\"/> --><application/></manifest>")
    rows = {r.package: r for r in readers.manifest_facts(spark, str(tmp_path)).collect()}
    assert rows["com.a"].permissions == ["P1", "P2"] and rows["com.a"].application == "com.a.App" and rows["com.a"].min_sdk is None
    assert rows[None].permissions == [] and rows[None].application is None


def test_links_of_components(spark, tmp_path):
    def intent(*pairs):
        return "    intents {\n" + "".join(f'      attributes {{\n        kind: {k}\n        value: "{v}"\n      }}\n' for k, v in pairs) + "    }\n"

    def component(name, kind, filters="", exits=""):
        return f'components {{\n  name: "{name}"\n  kind: {kind}\n  exported: true\n{filters}{exits}}}\n'

    def leave(n, kind, *intents):
        return f'  exit_points {{\n    instruction {{\n      method: "m"\n      id: {n}\n    }}\n    kind: {kind}\n{"".join(intents)}  }}\n'

    see = '  intent_filters {\n    attributes {\n      kind: ACTION\n      value: "SEE"\n    }\n  }\n'
    text = 'name: "p"\nversion: 1\n' + component("p.A", "ACTIVITY", see, leave(7, "SERVICE", intent(("ACTION", "SEE")), intent(("CLASS", "p/B"))) + leave(8, "ACTIVITY") + leave(9, "ACTIVITY", intent(("CLASS", "q/Other"))))
    text += component("p.B", "SERVICE", see) + component("p.C", "ACTIVITY", see, leave(3, "ACTIVITY", intent(("ACTION", "SEE"), ("CATEGORY", "x"))))
    path = _file(tmp_path, "p.txt", text)
    models, exits = readers.component_models(spark, path), readers.component_exits(spark, path)
    assert {(r.name, tuple(r.actions)) for r in models.collect()} == {(n, ("SEE",)) for n in ("p.A", "p.B", "p.C")}  # not those of exits
    assert {(r.name, r.stmt, r.action) for r in exits.collect()} == {("p.A", 7, "SEE"), ("p.A", 7, None), ("p.A", 9, None), ("p.C", 3, "SEE")}
    found = {(r.name, r.stmt, r.target, r.explicit) for r in readers.component_links(exits, models).collect()}
    assert found == {("p.A", 7, "p.B", False), ("p.A", 7, "p.B", True), ("p.C", 3, "p.A", False), ("p.C", 3, "p.C", False)}


def test_conditions_that_name_nothing(spark, tmp_path):
    path = _file(
        tmp_path, "s.xml",
        '<sinkSources><category id="NETWORK"><method signature="&lt;A: void b()&gt;"><additionalFlowCondition><signatureOnPath signature="s"/></additionalFlowCondition><additionalFlowCondition><excludeClassName className="x"/></additionalFlowCondition>'
        '<additionalFlowCondition><classNameOnPath className="c"/><excludeClassName className="x"/></additionalFlowCondition></method><method signature="none"/></category></sinkSources>',
    )
    rows = [(r.category, r.sig, r.nr, r.signatures, r.class_names, r.excluded) for r in readers.source_sink_conditions(spark, path).collect()]
    assert sorted(rows) == [("NETWORK", "<A: void b()>", 0, ["s"], [], []), ("NETWORK", "<A: void b()>", 2, [], ["c"], ["x"])]


def test_library_methods_run_what_they_are_given(spark):
    from trailhead.operators import frontend

    methods = spark.createDataFrame([("Task", "void run()", "Task.run"), ("Base", "void handleMessage(android.os.Message)", "Base.handle")], "class string, sub_sig string, sig string")
    edges = spark.createDataFrame([("Sub", "Base", False)], "sub string, sup string, is_interface boolean")
    post, send = "<android.os.Handler: boolean post(java.lang.Runnable)>", "<android.os.Handler: boolean sendMessage(android.os.Message)>"
    calls = spark.createDataFrame(
        [(1, post, ["Base", "Task"]), (2, send, ["Sub", "Message"]), (3, post, ["Base"]), (4, post, ["Task", None]), (5, "<a.B: void c()>", ["Task", "Task"]), (6, post, None)], "call long, callee string, classes array<string>"
    )
    assert {(r.call, r.sub_sig) for r in frontend.patched_calls(calls, methods, edges).collect()} == {(1, "void run()"), (2, "void handleMessage(android.os.Message)")}


def test_synthetic_methods_in_order_and_in_any(spark):
    from trailhead.operators import frontend

    entries = spark.createDataFrame([("A", "Activity", "A.a", 4), ("A", "Activity", "A.b", 0), ("A", "Activity", "A.b", 0)], "class string, component string, method string, step int")
    flow = lambda sequential: sorted((r.src, r.dst) for r in frontend.dummy_flow(entries, sequential).collect())
    assert flow(True) == [(0, 1), (1, 5), (5, -1)]
    assert flow(False) == [(0, -1), (0, 1), (0, 5), (1, 0), (5, 0)]
    assert frontend.dummy_flow(entries.limit(0)).isEmpty()


def test_constraints_of_summaries(spark, tmp_path):
    _file(
        tmp_path, "a.List.xml",
        '<summary><methods><method id="void add(int,E)"><constraints><index sourceSinkType="Parameter" ParameterIndex="0"/></constraints><flows/></method><method id="void add(E)"><constraints><index sourceSinkType="Implicit" ImplicitLocation="Next"/></constraints></method>'
        '<method id="E get(K)"><constraints><key sourceSinkType="Parameter" ParameterIndex="1"/></constraints></method><method id="int size()"><flows/></method></methods></summary>',
    )
    rows = {(r["class"], r.method, r.kind, r.source_sink_type, r.param, r.implicit_location) for r in readers.summary_constraints(spark, str(tmp_path)).collect()}
    assert rows == {("a.List", "void add(int,E)", "index", "Parameter", 0, None), ("a.List", "void add(E)", "index", "Implicit", None, "Next"), ("a.List", "E get(K)", "key", "Parameter", 1, None)}
