"""Findings of the fourth round: queries on small tables of their own, held against DuckDB."""

import inspect

import duckdb

import trailhead.plans.catalog as catalog
from tests.test_taint import st
from trailhead import storage
from trailhead.operators import frontend, hierarchy, provenance, reconstruction, results, summaries, taint
from trailhead.operators import tabulation as t

EVENTS = "CREATE TABLE events(event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)"


def against_sql(spark, folder, name, **tables):
    """The rows of a query over tables (name: SQL that makes it), which must be those of its SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        for statement in sql:
            con.execute(statement)
        con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    df = catalog.queries()[name](spark, str(folder))
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]}) t").fetchall()
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == sorted(found)
    return rows


def body(user, *steps):
    """SQL: statements of a method, (event type, number in props) each."""
    return [f"INSERT INTO events VALUES ({user * 100 + i}, TIMESTAMP '2024-01-01 00:00:{i:02}', {user}, '{kind}', 0, '{{\"k\": {k}}}')" for i, (kind, k) in enumerate(steps)]


def test_a_put_under_an_unknown_key_is_as_in_the_sql(spark, tmp_path):
    source, put, clean, unknown, get, sink = ("signup", 0), ("purchase", 0), ("signup", 3), ("purchase", 7), ("signup", 8), ("signup", 5)
    events = [EVENTS, *body(1, source, put, clean, get, sink), *body(2, source, put, clean, unknown, get, sink)]
    assert against_sql(spark, tmp_path, "taint_maps_in_loops", events=events) == [(100, 5, 1)]


def test_what_comes_back_alike_has_one_entry_for_all_sources(spark):
    """Five sources of a callee hold under one name at its end, so its caller is walked once and not five times."""
    rows = [("leaf", *st(n, "source", "x")) for n in range(1, 6)] + [("leaf", *st(6, "return", rhs="x")), ("main", *st(11, "call", "y", callee="leaf")), ("main", *st(12, "sink", args=["y"]))]
    rows = spark.createDataFrame(rows, taint.STATEMENT)
    flow = spark.createDataFrame([("leaf", n, 6) for n in range(1, 6)] + [("main", 11, 12)], "method string, src long, dst long")
    prog = t.compiled(rows, flow, spark.createDataFrame([("leaf", [])], "method string, names array<string>"))
    solution = t.tabulated(prog, t.seeds(rows.where("kind = 'source'").selectExpr("method", "stmt", "lhs AS base")), unbalanced=True)
    found = t.reached(solution, rows.where("kind = 'sink'").selectExpr("method", "stmt", "'y' AS base"))
    assert sorted(r.origin for r in found.collect()) == [f"leaf:{n}" for n in range(1, 6)]
    assert solution.facts.where("method = 'main'").select("entry").distinct().count() == 1


def test_sparse_ways_are_made_in_one_pass(spark, monkeypatch):
    """Sixty statements that don't concern the name are passed at once, not in rounds that each write all ways anew."""
    labels, written = [], t.written
    monkeypatch.setattr(t, "written", lambda df, label: labels.append(label) or written(df, label))
    rows = spark.createDataFrame([("m", *st(0, "source", "x")), *(("m", *st(n, "nop")) for n in range(1, 60)), ("m", *st(60, "sink", args=["x"]))], taint.STATEMENT)
    prog = t.compiled(rows, spark.createDataFrame([("m", n, n + 1) for n in range(60)], "method string, src long, dst long"), spark.createDataFrame([], "method string, names array<string>"))
    labels.clear()
    ways = t.sparse(prog, rows.where("kind = 'sink'").selectExpr("method", "stmt", "'x' AS base"))
    assert {(r.src, r.dst) for r in ways.where("base = 'x'").collect()} == {(n, 60) for n in range(60)} | {(60, t.EXIT)}
    assert labels.count("ways") == 1


def top(df):
    """The topmost operator of a plan, which is Aggregate where the rows of a result are shuffled to be made distinct."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")[0].split()[0]


def test_targets_are_found_once_for_a_class_and_method(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("e", None)], "sub string, sup string")
    methods = spark.createDataFrame([("a", "m"), ("b", "m"), ("b", "m"), ("d", "k"), ("x", "m")], "class string, sub_sig string")
    calls = spark.createDataFrame([(1, "a", "m"), (1, "a", "m"), (2, "b", "m"), (2, "c", "m"), (3, "d", "k"), (4, "x", "m"), (5, None, "m"), (6, "a", "none"), (None, "c", "m")], "call int, class string, sub_sig string")
    found = hierarchy.dispatch(calls, methods, edges)
    want = {(1, "m", "a"), (1, "m", "b"), (2, "m", "a"), (2, "m", "b"), (3, "k", "d"), (None, "m", "a")}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert {tuple(r) for r in hierarchy.dispatch(calls, methods, edges, outside=True).collect()} == want | {(4, "m", "x")}
    assert top(found) == "Union"


def test_patched_calls_are_not_made_distinct_as_pairs(spark):
    edges = spark.createDataFrame([("b", "a")], "sub string, sup string")
    methods = spark.createDataFrame([("a", "void run()"), ("b", "void run()"), ("x", "void run()")], "class string, sub_sig string")
    start, post = "<java.lang.Thread: void start()>", "<android.os.Handler: boolean post(java.lang.Runnable)>"
    calls = spark.createDataFrame([(1, start, ["a"]), (2, post, [None, "x"]), (3, post, ["a"]), (4, start, ["b", "a"]), (1, start, ["b"])], "call int, callee string, classes array<string>")
    found = frontend.patched_calls(calls, methods, edges)
    want = {(1, "void run()", "a"), (1, "void run()", "b"), (2, "void run()", "x"), (4, "void run()", "b")}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert top(found) == "Union"


def test_links_are_not_made_distinct_as_pairs(spark):
    """Statements that ask in several ways, or for components that several rows name, have each link once."""
    columns = "stmt int, src string, package string, target string, action string"
    sends = [(1, "s", "p", None, "go"), (1, "s", "p", None, "go"), (2, "s", "p", "c", None), (2, "s", "p", None, "go"), (3, "s", "q", None, "go"), (3, "s", "q", None, "run"), (4, "s", None, None, "go"), (5, "s", "q", "none", "go"), (6, "s", "q", "c", "go"), (6, "s", "q", "c", "run")]
    made = [("c", "p", False, ["go", "run"]), ("c", "q", False, ["go"]), ("d", "p", True, ["go", "go"]), ("d", "p", True, ["run"]), ("e", None, None, ["go"])]
    found = frontend.component_links(spark.createDataFrame(sends, columns), spark.createDataFrame(made, "name string, package string, exported boolean, actions array<string>"))
    want = {(n, "s", name) for n, _, package, target, action in sends for name, home, exported, actions in made if (target == name if target else action in actions and (exported or package and home == package))}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert top(found) == "Union"


def test_listeners_are_not_made_distinct_as_pairs(spark):
    methods = spark.createDataFrame([("A", "onClick", 10), ("A", "onClick", 10), ("B", "lambda$x", 11), ("B", "other", 12), ("A", "lambda$y", 13), ("B", "lambda$y", 13)], "class string, name string, sig int")
    registrations = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "B"), (3, None)], "method int, listener_class string")
    edges = spark.createDataFrame([(1, 10), (1, 12), (1, 12), (2, 10), (9, 9)], "src int, dst int")
    found = frontend.listener_edges(edges, registrations, methods)
    want = {(1, 10), (1, 11), (1, 13), (2, 11), (2, 13), (1, 12), (2, 10), (9, 9)}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert top(found) == "Union"


def test_only_owners_with_flows_are_looked_for_below_a_class(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b")], "sub string, sup string")
    flows = spark.createDataFrame([("b", "m", "f1"), ("c", "m", "f2"), ("a", "k", "f3")], "class string, method string, flow string")
    calls = spark.createDataFrame([(1, "a", "m"), (2, "d", "m"), (3, "d", "k"), (4, "c", "none")], "call int, class string, method string")
    found = summaries.resolved(calls, flows, edges)
    assert sorted((r.call, r.owner, r.flow) for r in found.collect()) == [(1, "b", "f1"), (1, "c", "f2"), (2, "b", "f1"), (3, "a", "f3")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 2


def test_frames_are_bounded_by_bytes(spark):
    """Rows that hold whole methods don't fill a batch by the thousand, in the operators that hand them to Python."""
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat(CAST(id AS STRING), 4000) AS body")

    def run(frames):
        for frame in frames:
            yield frame.assign(n=len(frame))[["id", "n"]]

    assert storage.in_frames(rows, run, "id long, n long").agg({"n": "max"}).first()[0] < 1000
    for module in (taint, t, provenance):
        assert ".mapInPandas(" not in inspect.getsource(module)


def test_origins_of_a_static_are_not_carried_to_each_reader(spark, monkeypatch):
    """Eight writers and eight readers of a static make 64 flows, which are in the result only; a reader that also writes passes all on."""
    stmts = [row for n in range(8) for row in ((f"w{n}", *st(1, "source", "x")), (f"w{n}", *st(2, "assign", "static s", "x")), (f"r{n}", *st(1, "assign", "y", "static s")), (f"r{n}", *st(2, "sink", args=["y"])))]
    stmts += [("pass", *st(1, "assign", "static u", "static s")), ("own", *st(1, "source", "y")), ("own", *st(2, "sink", args=["y"])), ("own", *st(3, "assign", "static u", "y")), ("last", *st(1, "assign", "y", "static u")), ("last", *st(2, "sink", args=["y"]))]
    stmts += [("mine", *st(1, "source", "static s")), ("mine", *st(2, "assign", "y", "static s")), ("mine", *st(3, "sink", args=["y"]))]
    flow = [(f"{k}{n}", 1, 2) for k in "wr" for n in range(8)] + [("own", 1, 2), ("own", 2, 3), ("last", 1, 2), ("mine", 1, 2), ("mine", 2, 3)]
    stmts, sizes, written = spark.createDataFrame(stmts, taint.STATEMENT), [], t.written
    prog = t.compiled(stmts, spark.createDataFrame(flow, "method string, src long, dst long"), spark.createDataFrame([], "method string, names array<string>"))
    solution = t.with_globals(prog, t.seeds(stmts.where("kind = 'source'").selectExpr("method", "stmt", "lhs AS base")))
    monkeypatch.setattr(t, "written", lambda df, label: (out := written(df, label), sizes.append(out.count()))[0])
    found = t.reached(solution, stmts.where("kind = 'sink'").selectExpr("method", "stmt", "'y' AS base")).collect()
    every = {f"w{n}:1" for n in range(8)} | {"mine:1"}
    want = {(f"r{n}", o) for n in range(8) for o in every} | {("mine", o) for o in every} | {("last", o) for o in every | {"own:1"}} | {("own", "own:1")}
    assert sorted((r.method, r.origin) for r in found) == sorted(want)
    assert max(sizes) < 64


def test_pairs_between_are_made_after_flows_are_joined(spark):
    sources = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 0), (4, None)], "source int, place int")
    sinks = spark.createDataFrame([(7, 0), (8, 0), (9, 1), (10, None)], "sink int, place int")
    found = spark.createDataFrame([(1, 8, "A"), (1, 8, "B"), (1, 9, "A"), (2, 9, "A"), (None, 7, "A"), (3, None, "A")], "source int, sink int, kind string")
    pairs = sources.join(sinks, "place").select("source", "sink")
    got = sorted(map(tuple, results.between_all(sources, sinks, "place", found).collect()))
    assert got == sorted(map(tuple, results.between(pairs, found).collect()))
    assert got == [(1, 7, False), (1, 7, False), (1, 8, True), (1, 8, True), (2, 9, True), (3, 7, False), (3, 8, False)]


def test_the_query_on_pairs_between_has_no_join_of_pairs_with_flows(spark, tmp_path):
    """The last join of the plan is the one that makes the pairs."""
    tables = {"part": ["CREATE TABLE part AS SELECT range::BIGINT AS p_partkey, (range % 50)::INTEGER AS p_size FROM range(40)"], "supplier": ["CREATE TABLE supplier AS SELECT range::BIGINT AS s_suppkey, (range % 25)::INTEGER AS s_nationkey FROM range(60)"]}
    tables["lineitem"] = ["CREATE TABLE lineitem AS SELECT (range % 40)::BIGINT AS l_partkey, (range * 7 % 60)::BIGINT AS l_suppkey, 'A' AS l_returnflag FROM range(300)"]
    assert {r[2] for r in against_sql(spark, tmp_path, "paths_between", **tables)} == {True, False}
    plan = catalog.queries()["paths_between"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert next(line for line in plan.split("\n") if "Join " in line).split("Join ")[1].startswith("Inner")


def test_walks_are_joined_once_in_each_round(spark):
    """What ended is read from the round's rows, so the result has no joins that are run again all in one plan."""
    pred = [(f"f{n}", f"f{n + 1}", f"m:{n}", None, False) for n in range(6)] + [("f0", "f3", "m:9", None, False)]
    pred = spark.createDataFrame(pred, "fact string, pred string, stmt string, call_site string, is_return boolean")
    found = reconstruction.paths(pred, spark.createDataFrame([("s", "f0")], "sink string, fact string"), max_paths=None, max_length=None)
    assert sorted((r.source, r.path) for r in found.collect()) == [("f6", ["m:5", "m:4", "m:3", "m:2", "m:1", "m:0"]), ("f6", ["m:5", "m:4", "m:3", "m:9"])]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
