"""Summaries, front-end relations, containers, text functions, recursion and streams."""

import pytest
from pyspark.sql import functions as F

from trailhead.functions import containers as k
from trailhead.functions import text as t
from trailhead.operators import constraints, frontend, hierarchy, recursion, summaries
from trailhead.streaming import streams

END = "struct<kind: string, param: int, fields: array<string>, match_strict: boolean, base_type: string>"


def end(kind, param=None, fields=(), strict=False, type_=None):
    return (kind, param, list(fields), strict, type_)


def flows_of(spark, rows):
    return spark.createDataFrame(rows, f"class string, method string, from {END}, to {END}, is_alias boolean")


# -- summaries


def test_summary_resolution_prefers_the_nearest(spark):
    flows = flows_of(spark, [(c, m, end("Parameter", 0), end("Field", fields=[c]), False) for c, m in (("Base", "m"), ("Sub", "m"), ("LeafA", "n"), ("LeafB", "n"), ("Iface", "o"))])
    edges = spark.createDataFrame([("Sub", "Base"), ("LeafA", "Sub"), ("LeafB", "Sub"), ("Sub", "Iface")], "sub string, sup string")
    calls = spark.createDataFrame([(1, "Sub", "m"), (2, "LeafA", "m"), (3, "Sub", "n"), (4, "LeafB", "o"), (5, "Base", "zzz")], "call long, class string, method string")
    found = {(r["call"], r["owner"]) for r in summaries.resolved(calls, flows, edges).collect()}
    assert found == {(1, "Sub"), (2, "Sub"), (3, "LeafA"), (3, "LeafB"), (4, "Iface")}
    assert [tuple(r) for r in summaries.missing(calls, flows).where("class = 'Base'").collect()] == [("Base", "zzz", 1)]


def test_summary_application_and_clears(spark):
    flows = spark.createDataFrame([(1, end("Parameter", 0), end("Field", fields=["inner"])), (2, end("Field", fields=["inner"]), end("Return"))], f"call long, from {END}, to {END}")
    clears = spark.createDataFrame([(3, end("Field", fields=["inner"]))], f"call long, clear {END}")
    taints = spark.createDataFrame([(1, "Parameter", 0, ["f"]), (2, "Field", None, ["inner", "g"]), (2, "Field", None, ["other"]), (3, "Field", None, ["inner", "g"]), (3, "Field", None, ["x"])], "call long, kind string, param int, fields array<string>")
    got = {(r["call"], r["kind"], tuple(r["fields"])) for r in summaries.applied(taints, flows, clears).collect()}
    assert got == {(1, "Parameter", ("f",)), (1, "Field", ("inner", "f")), (2, "Field", ("inner", "g")), (2, "Return", ("g",)), (2, "Field", ("other",)), (3, "Field", ("x",))}


def test_compaction_keeps_precise_flows(spark):
    rows = [
        ("C", "m", end("Parameter", 0), end("Return"), False), ("C", "m", end("Parameter", 0, ["f"]), end("Return"), False), ("C", "m", end("Parameter", 0, ["f"]), end("Return"), False),
        ("C", "m", end("Parameter", 1), end("Return"), True), ("C", "m", end("Return"), end("Parameter", 1), True),
    ]
    got = {(r["from"]["kind"], r["from"]["param"], tuple(r["from"]["fields"]), r["is_alias"]) for r in summaries.compacted(flows_of(spark, rows)).collect()}
    assert got == {("Parameter", 0, ("f",), False), ("Return", None, (), True)}
    assert summaries.aliases(flows_of(spark, rows)).count() == 2
    needs = flows_of(spark, [("C", "m", end("Field", type_="D"), end("Return", type_="C"), False)])
    assert [tuple(r) for r in summaries.dependencies(needs).collect()] == [("C", "D")]


def test_wrapper_list_by_nearest_class(spark):
    rules = spark.createDataFrame([("propagate", "Base", "m"), ("exclude", "Sub", "m"), ("kill", "Base", "n"), ("propagate", "Base", "n")], "kind string, class string, method string")
    edges = spark.createDataFrame([("Sub", "Base"), ("Leaf", "Sub")], "sub string, sup string")
    calls = spark.createDataFrame([(1, "Leaf", "m"), (2, "Base", "m"), (3, "Sub", "n")], "call long, class string, method string")
    assert dict(summaries.listed(calls, rules, edges).collect()) == {1: "exclude", 2: "propagate", 3: "kill"}


# -- front end and hierarchy


def test_dispatch_and_overrides(spark):
    edges = spark.createDataFrame([("B", "A"), ("C", "B")], "sub string, sup string")
    methods = spark.createDataFrame([("A", "m"), ("C", "m")], "class string, sub_sig string")
    calls = spark.createDataFrame([(1, "A", "m"), (2, "B", "m")], "call long, class string, sub_sig string")
    assert {(r["call"], r["target"]) for r in hierarchy.dispatch(calls, methods, edges).collect()} == {(1, "A"), (1, "C"), (2, "A"), (2, "C")}
    assert [tuple(r) for r in hierarchy.overridden(methods, edges).collect()] == [("C", "m", "A")]
    pairs = spark.createDataFrame([("A", "C"), ("C", "A"), ("A", "X"), ("A", "A")], "a string, b string")
    assert {(r["a"], r["b"]): r["precise"] for r in hierarchy.more_precise(pairs, edges).collect()} == {("A", "C"): "C", ("C", "A"): "C", ("A", "X"): None, ("A", "A"): "A"}


def test_callbacks_entry_points_and_links(spark):
    edges = spark.createDataFrame([("Tap", "OnClickListener"), ("Main", "Activity")], "sub string, sup string")
    methods = spark.createDataFrame([("Tap", "onClick", "void onClick(V)", "<Tap: onClick>"), ("Main", "onCreate", "void onCreate(B)", "<Main: onCreate>"), ("Activity", "onCreate", "void onCreate(B)", "<Activity: onCreate>")], "class string, name string, sub_sig string, sig string")
    interfaces = spark.createDataFrame([("OnClickListener", "void onClick(V)")], "name string, sub_sig string")
    invokes = spark.createDataFrame([("Main", "Tap"), ("Main", "Main")], "component string, arg_class string")
    assert [tuple(r) for r in frontend.registered_callbacks(invokes, interfaces, methods, edges).collect()] == [("Main", "<Tap: onClick>")]
    components = spark.createDataFrame([("Main", "Activity")], "class string, component string")
    entries = frontend.entry_points(components, methods)
    assert [tuple(r) for r in entries.collect()] == [("Main", "Activity", "<Main: onCreate>", 0)]
    framework = spark.createDataFrame([("Activity",)], "class string")
    assert [tuple(r) for r in frontend.overriding_callbacks(components, methods, edges, framework).collect()] == [("Main", "<Main: onCreate>")]
    calls = spark.createDataFrame([("<Main: onCreate>", "help"), ("<Tap: onClick>", "danger")], "src string, dst string")
    registrations = spark.createDataFrame([("help", "<Tap: onClick>")], "method string, callback string")
    assert {r["method"] for r in frontend.discovered(components, entries, calls, registrations).collect()} == {"<Main: onCreate>", "help", "<Tap: onClick>", "danger"}
    assert frontend.discovered(components, entries, calls, registrations, cap=0).count() == 0
    parts = spark.createDataFrame([("A", "p", True, ["go"]), ("B", "p", False, ["go"]), ("C", "q", False, ["go"])], "name string, package string, exported boolean, actions array<string>")
    sends = spark.createDataFrame([(1, "m", "p", None, "go"), (2, "m", "p", "C", None)], "stmt long, src string, package string, target string, action string")
    assert {(r["stmt"], r["dst"]) for r in frontend.component_links(sends, parts).collect()} == {(1, "A"), (1, "B"), (2, "C")}
    accessors = spark.createDataFrame([("a", "C$$Nest$mrun")], "src string, dst string")
    assert {r["dst"] for r in frontend.accessor_edges(accessors).collect()} == {"C$$Nest$mrun", "Crun"}


# -- recursion


def test_limited_callers_and_cycles(spark):
    edges = spark.createDataFrame([("c1", "s"), ("c2", "s"), ("r1", "c1"), ("r2", "c1"), ("r3", "c1"), ("a", "b"), ("b", "a"), ("b", "t")], "src string, dst string")
    sinks = spark.createDataFrame([("s",), ("t",), ("u",)], "node string")
    paths = {tuple(r["path"]) for r in recursion.caller_paths(edges, sinks).collect()}
    assert paths == {("r1", "c1", "s"), ("r2", "c1", "s"), ("r3", "c1", "s"), ("u",)}  # one direct caller; the cycle emits nothing
    back = recursion.simple_paths(recursion.reversed_edges(edges), spark.createDataFrame([("t",)], "node string"), 10, emit_cycles=True)
    assert {(tuple(r["path"]), r["kind"]) for r in back.collect()} == {(("t", "b", "a"), "cyclic")}
    walks = recursion.bounded_walks(spark.createDataFrame([("x", "x"), ("x", "y")], "src string, dst string"), spark.createDataFrame([("x",)], "node string"), 10)
    assert {tuple(r["path"]) for r in walks.collect()} == {("x", "y"), ("x", "x", "y")}


# -- constraints, text and containers


def test_conflicts_of_each_kind(spark):
    kind = "array<struct<kind: string, method: string, variable: string, operator: string, value: string, branch: boolean, text: string>>"
    one = lambda kind, method="m", variable="v", operator="==", value="1", branch=True, text="t": (kind, method, variable, operator, value, branch, text)
    cases = {
        "branch": ([one("CONDITIONAL"), one("CONDITIONAL", branch=False)], "incompatible constraints"), "same": ([one("CONDITIONAL"), one("CONDITIONAL")], None),
        "cases": ([one("SWITCH"), one("SWITCH", value="2")], "incompatible constraints"), "kinds": ([one("SWITCH"), one("CONDITIONAL", branch=False)], None),
        "param": ([one("PARAMETER"), one("PARAMETER", value="2")], "incompatible constraints"), "field": ([one("FIELD"), one("FIELD", value="2")], "incompatible constraints"),
        "component": ([one("ANDROID"), one("ANDROID", value="2")], None), "blank": ([one("FIELD", text=" ")], "blank constraint"), "none": ([], None),
    }
    rows = spark.createDataFrame([(n, ["m"], c) for n, (c, _) in cases.items()] + [("empty", [], [])], f"path_id string, methods array<string>, constraints {kind}")
    got = {r["path_id"]: r["reason"] for r in constraints.validated(rows).collect()}
    assert got == {n: r for n, (_, r) in cases.items()} | {"empty": "empty method sequence"}
    texts = {r["path_id"]: r["e"] for r in rows.select("path_id", constraints.logical_expression("constraints").alias("e")).collect()}
    assert texts["none"] == "true" and texts["blank"] == " " and texts["same"] == "(t) AND (t)"


@pytest.mark.parametrize(
    "sig, kind",
    [("<A: void onStartCommand()>", "activity_lifecycle"), ("<java.lang.Runtime: exec()>", "background_thread"), ("<A: void onBind()>", "service_lifecycle"), ("<A: void other()>", "application_method"), (None, "unknown")],
)
def test_path_types_keep_their_order(spark, sig, kind):
    assert spark.createDataFrame([(sig,)], "s string").select(t.path_type("s")).first()[0] == kind


def test_free_answers_and_conditions(spark):
    answers = ["Answer: \"x > 1\" (because)", "This is\nx == 2", None, "[a]"]
    got = [r[0] for r in spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").orderBy("i").select(t.clean_response("a")).collect()]
    assert got == ['x > 1"', "x == 2", "", "a"]  # quotes go before asides do
    rows = [("x >= 5", ""), ("?", "$i0 gt -3"), ("?", "a ne b"), ("?", "z")]
    got = [tuple(r[0]) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, r string").orderBy("i").select(t.condition("t", "r")).collect()]
    assert got == [("x", ">=", "5"), ("$i0", ">", "-3"), ("a", "!=", "b"), ("unknown", "unknown", "unknown")]
    assert spark.range(1).select(t.method_name(F.lit("<a.B: int run(int)>")), t.fallback_parameter(F.lit("$r1"), F.lit(0)), t.fallback_parameter(F.lit("$x"), F.lit(2))).first()[:] == ("run", None, "param[2] = var_x")


def test_containers_and_access_paths(spark):
    array = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    one, two, wide = (k.interval(F.lit(a), F.lit(b)) for a, b in ((1, 1), (2, 2), (1, 3)))
    row = spark.range(1).select(
        k.intersects(one, one), k.intersects(one, two), k.intersects(one, wide), k.interval_entails(wide, one), k.shift(wide, F.lit(2))["max"], k.shift(wide, F.lit(2), compat=True)["max"],
        k.keys_intersect(array("a"), array("a")), k.keys_intersect(array("a"), array("b")), k.keys_intersect(array("a"), array("a", "b")), k.keys_entail(array("a"), array("a", "b")),
        k.starts_with(array("f", "g"), array("f")), k.rebased(array("f", "g"), array("f"), array("h")), k.append(array("a", "b", "c", "d"), array("e", "f"))["cut_off"], k.without_loops(array("n", "n", "v")),
        k.path_entails(F.lit("x"), array("f"), F.lit(True), F.lit("x"), array()), k.path_entails(F.lit("x"), array("f"), F.lit(True), F.lit("x"), array(), compat=False), k.path_entails(F.lit("x"), array(), F.lit(True), F.lit("x"), array("f")),
    ).first()
    assert row[:] == (True, False, None, True, 5, 3, True, False, None, True, True, ["h", "g"], True, ["n", "v"], True, False, True)


# -- streams


def test_interactions_are_assembled(spark, tmp_path):
    rows = [("1", "prompt", "p1", None), ("1", "response", "r1", True), ("2", "prompt", "p2", None)]
    schema = "id string, event string, text string, success boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = lambda: streams.assembled(log).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([("2", "response", "r2", False)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("1", "p1", "r1", True, 2), ("2", "p2", "r2", False, 2)}


def test_repeated_batches_append_nothing_twice(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "app_id string").write.parquet(str(tmp_path / "in"))
    for state in ("one", "two"):
        rows = spark.readStream.schema("app_id string").parquet(str(tmp_path / "in"))
        streams.resumable(rows, str(tmp_path / "done")).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["app_id"] for r in spark.read.parquet(str(tmp_path / "done")).collect()) == ["a", "b"]


@pytest.mark.parametrize("limit", [100, 5, None])
def test_paths_run_to_their_natural_end(spark, limit):
    pairs = [(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (4, 9), (9, 10), (10, 9), (2, 11), (11, 8)]  # 9 and 10 lead to no end
    succ = {}
    for u, v in pairs:
        succ.setdefault(u, []).append(v)
    edges, starts = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(1,), (3,), (8,), (9,)], "node long")
    whole, simple, cyclic = [], set(), set()

    def walk(path, visits):
        if path[-1] not in succ:
            (whole.append if visits == 2 else simple.add)(tuple(path))
        for v in succ.get(path[-1], ()):
            if path.count(v) < visits:
                walk([*path, v], visits)
            elif visits == 1:
                cyclic.add(tuple(path))

    for start in (1, 3, 8, 9):
        walk([start], 2)
        walk([start], 1)
    wanted = set()
    for start in (1, 3, 8, 9):
        wanted |= set(sorted((p for p in whole if p[0] == start), key=lambda p: (len(p), [f"{x:012}" for x in p]))[:limit])
    found = recursion.bounded_walks(edges, starts, limit=limit).collect()
    assert sorted((r["start"], tuple(r["path"])) for r in found) == sorted((p[0], p) for p in wanted) and max(map(len, whole)) > 8
    if limit == 100:
        rows = {(tuple(r["path"]), r["kind"]) for r in recursion.simple_paths(edges, starts, emit_cycles=True).collect()}
        assert rows == {(p, "complete") for p in simple} | {(p, "cyclic") for p in cyclic}


def test_responses_are_parsed_from_whole_texts(spark, tmp_path):
    import trailhead.plans.catalog as catalog

    prompt, answer = "p" * 300 + " the end of the prompt", "a" * 300 + "\nBOOLEAN_CONSTRAINT_END beyond"
    rows = [(1, 0, "user", prompt), (1, 1, "assistant", answer), (2, 0, "user", prompt)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r for r in catalog.queries()["structured_responses_whole"](spark, str(tmp_path)).collect()}
    assert (found[1]["format1"], found[1]["format3"]) == ("a" * 300, prompt)
    assert (found[2]["format1"], found[2]["format3"]) == ("unknown_condition", prompt)
