"""Small cases of operators whose queries run on tables too regular for them."""

from trailhead.operators import appgraph, results, taint
from trailhead.sources import writers


def test_apps_with_like_names_get_folders_of_their_own(spark, tmp_path):
    long = "a" * 150
    docs = spark.createDataFrame([("a/b", "1"), ("a_b", "2"), (long + "x", "3"), (long + "y", "4")], "app_id string, document string")
    writers.write_documents(docs, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1", "2", "3", "4"]
    folders = [p.name for p in (tmp_path / "out").glob("app_id=*")]
    assert len(folders) == 4 and f"app_id={long}x" in folders


def test_component_methods_follow_calls_from_their_own(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "e")], "src string, dst string")
    own = spark.createDataFrame([("K", "a"), ("L", "d"), ("L", "c")], "component string, method string")
    found = {tuple(r) for r in appgraph.component_methods(calls, own).collect()}
    assert found == {("K", "a"), ("K", "b"), ("K", "c"), ("L", "d"), ("L", "e"), ("L", "c")}


def test_backward_flows_are_the_forward_ones(spark):
    row = lambda n, kind, lhs=None, rhs=None, args=(): ("m", n, kind, lhs, None, rhs, None, None, None, list(args), None)
    stmts = spark.createDataFrame([row(1, "source", "x"), row(2, "assign", "y", "x"), row(3, "assign", "x"), row(4, "sink", None, None, ["y", "x"]), row(5, "source", "z"), row(6, "cast", "y", "z"), row(7, "sink", None, None, ["y"])], taint.STATEMENT)
    edges = spark.createDataFrame([("m", i, i + 1) for i in range(1, 7)] + [("m", 6, 2)], "method string, src long, dst long")
    none = spark.createDataFrame([], "method string, names array<string>")
    back = {tuple(r) for r in taint.backward(stmts, edges).collect()}
    forward = {tuple(r) for r in taint.flows(stmts, edges, none, spark.createDataFrame([("m",)], "method string")).collect()}
    assert back == forward and ("m", 7, 5, "y") in back and ("m", 4, 1, "y") in back and not any(r[1] == 4 and r[3] == "x" for r in back)


def test_statics_pass_by_callees_that_never_touch_them(spark):
    s = {"lhs_field": None, "rhs_field": None, "base": None, "type": None}
    body = [
        {"stmt": 1, "kind": "source", "lhs": "static g", "rhs": None, "callee": None, "args": [], **s},
        {"stmt": 2, "kind": "call", "lhs": None, "rhs": None, "callee": "f", "args": [], **s},
        {"stmt": 3, "kind": "sink", "lhs": None, "rhs": None, "callee": None, "args": ["static g"], **s},
    ]
    succ = {1: [2], 2: [3]}
    _, calls, hits = taint.solve_method("m", body, succ, [taint.ZERO], {}, {"f": []}, taint.Rules(), {})
    assert hits and calls == {("f", taint.ZERO)}
    _, calls, hits = taint.solve_method("m", body, succ, [taint.ZERO], {}, {"f": []}, taint.Rules(), {"f": {"static g"}})
    assert not hits and ("f", "1|static g|") in calls


def test_results_are_removed_by_sink_and_by_pair(spark):
    found = spark.createDataFrame([(1, 2), (1, 3), (4, 2)], "source long, sink long")
    assert {tuple(r) for r in results.without(found, spark.createDataFrame([(2,)], "sink long")).collect()} == {(1, 3)}
    assert {tuple(r) for r in results.without(found, spark.createDataFrame([(1, 2)], "source long, sink long")).collect()} == {(1, 3), (4, 2)}
    assert {tuple(r) for r in results.swapped(found).collect()} == {(2, 1), (3, 1), (2, 4)}
