"""The solver on tables of path edges, on micro-programs and against walks by brute force."""

import random
from collections import defaultdict

import pytest

from tests.test_taint import HELPERS, PROGRAMS, WRAPPERS, st
from trailhead.operators import cfg, recursion, taint
from trailhead.operators import tabulation as t

SKIPPED = {"bad_cast"}  # casts aren't checked by types here
MORE = {
    "alias_before": ([st(1, "assign", "b", "a"), st(2, "source", "x"), st(3, "assign", "a", "x", lf="f"), st(4, "assign", "y", "b", rf="f"), st(5, "sink", args=["y"])], 1),
    "alias_after": ([st(1, "source", "x"), st(2, "assign", "a", "x", lf="f"), st(3, "assign", "b", "a"), st(4, "assign", "y", "b", rf="f"), st(5, "sink", args=["y"])], 1),
    "old_value": ([st(1, "assign", "b", "a"), st(2, "assign", "y", "b", rf="f"), st(3, "source", "x"), st(4, "assign", "a", "x", lf="f"), st(5, "sink", args=["y"])], 0),
    "no_alias_any_more": ([st(1, "assign", "b", "a"), st(2, "assign", "b"), st(3, "source", "x"), st(4, "assign", "a", "x", lf="f"), st(5, "assign", "y", "b", rf="f"), st(6, "sink", args=["y"])], 0),
    "alias_of_old_base": ([st(1, "assign", "b", "a"), st(2, "assign", "a"), st(3, "source", "x"), st(4, "assign", "a", "x", lf="f"), st(5, "assign", "y", "b", rf="f"), st(6, "sink", args=["y"])], 0),
    "alias_in_field": ([st(1, "assign", "c", "a", lf="g"), st(2, "source", "x"), st(3, "assign", "a", "x", lf="f"), st(4, "assign", "d", "c", rf="g"), st(5, "assign", "y", "d", rf="f"), st(6, "sink", args=["y"])], 1),
    "alias_by_load": ([st(1, "assign", "a", "c", rf="g"), st(2, "source", "x"), st(3, "assign", "a", "x", lf="f"), st(4, "assign", "d", "c", rf="g"), st(5, "assign", "y", "d", rf="f"), st(6, "sink", args=["y"])], 1),
    "alias_of_argument": ([st(1, "assign", "b", "o"), st(2, "source", "x"), st(3, "call", callee="put", args=["o", "x"]), st(4, "assign", "y", "b", rf="v"), st(5, "sink", args=["y"])], 1),
}
ALL = {k: v for k, v in (PROGRAMS | MORE).items() if k not in SKIPPED}


def tables(spark, programs):
    stmts, flow, params, offset = [], [], [], 0
    for name, (names, body) in [*((n, ([], b)) for n, (b, _) in programs.items()), *HELPERS.items()]:
        offset += 100
        params.append((name, names))
        stmts += [(name, offset + s[0], *s[1:]) for s in body]
        flow += [(name, offset + a[0], offset + b[0]) for a, b in zip(body, body[1:], strict=False)]
        if name == "again":
            flow.append((name, offset + 1, offset + 3))
    return spark.createDataFrame(stmts, taint.STATEMENT), spark.createDataFrame(flow, "method string, src long, dst long"), spark.createDataFrame(params, "method string, names array<string>")


@pytest.fixture(scope="module")
def parts(spark):
    from pyspark.sql import functions as F

    stmts, flow, params = tables(spark, ALL)
    wrappers = [(callee, a, ".".join(p), b, ".".join(q)) for callee, w in WRAPPERS.items() for a, p, b, q in w["flows"]]
    clears = [(callee, a, ".".join(p)) for callee, w in WRAPPERS.items() for a, p in w.get("kill", ())]
    prog = t.compiled(
        stmts, flow, params, spark.createDataFrame(wrappers, "callee string, base string, path string, to string, to_path string"), spark.createDataFrame(clears, "callee string, base string, path string")
    )
    sources = t.seeds(stmts.where("kind = 'source'").selectExpr("method", "stmt", "lhs AS base"))
    return prog, sources, stmts.where("kind = 'sink'").select("method", "stmt", F.explode("args").alias("base"))


def test_number_of_flows(parts):
    prog, sources, sinks = parts
    found = defaultdict(set)
    for r in t.reached(t.with_aliases(prog, sources, unbalanced=True), sinks).collect():
        found["static" if r.method == "leak_static" else r.method].add((r.stmt, r.origin))
    assert {name: len(found[name]) for name in ALL} == {name: n for name, (_, n) in ALL.items()}


def test_returns_past_the_first_method_are_an_option(parts):
    prog, sources, sinks = parts
    assert not [r for r in t.reached(t.tabulated(prog, sources), sinks).collect() if r.method == "callee_source"]


def test_backwards_and_sparse_give_the_same_pairs(parts):
    prog, sources, sinks = parts
    dense = t.tabulated(prog, sources, unbalanced=True)
    want = {(f"{r.method}:{r.stmt}", r.origin) for r in t.reached(dense, sinks).collect()}
    thin = t.tabulated(prog, sources, unbalanced=True, ways=t.sparse(prog, sinks))
    assert {(f"{r.method}:{r.stmt}", r.origin) for r in t.reached(thin, sinks).collect()} == want
    assert thin.facts.count() < dense.facts.count()
    back = t.tabulated(t.converse(prog).written(), t.seeds(sinks), unbalanced=True)
    assert {(r.origin, f"{r.method}:{r.stmt}") for r in t.reached(back, sources.select("method", "stmt", "base")).collect()} == want


def test_a_model_stops_at_a_gap_and_goes_on(spark):
    from pyspark.sql import functions as F

    programs = {
        "mapped": ([st(1, "source", "x"), st(2, "call", "y", callee="map", base="l", args=["x"]), st(3, "sink", args=["y"])], 1),
        "blocked": ([st(1, "source", "x"), st(2, "call", "y", callee="filter", base="l", args=["x"]), st(3, "sink", args=["y"])], 0),
        "emptied": ([st(1, "source", "x"), st(2, "call", callee="add", base="l", args=["x"]), st(3, "call", callee="clear", base="l"), st(4, "call", "y", callee="get", base="l"), st(5, "sink", args=["y"])], 0),
        "kept": ([st(1, "source", "x"), st(2, "call", callee="add", base="l", args=["x"]), st(3, "call", "y", callee="get", base="l"), st(4, "sink", args=["y"])], 1),
        "unknown": ([st(1, "source", "x"), st(2, "call", "y", callee="nobody", args=["x"]), st(3, "sink", args=["y"])], 1),
        "chained": ([st(1, "source", "x"), st(2, "call", "y", callee="twice", args=["x"]), st(3, "sink", args=["y"])], 1),
    }
    stmts, flow, params = tables(spark, programs)
    models = [("map", "arg0", "", "gap1.arg0", ""), ("map", "gap1.return", "", "return", ""), ("filter", "arg0", "", "gap1.arg0", ""), ("filter", "gap1.return", "", "return", ""), ("add", "arg0", "", "base", "e"), ("get", "base", "e", "return", "")]
    models += [("twice", "arg0", "", "gap1.arg0", ""), ("twice", "gap1.return", "", "gap2.arg0", ""), ("twice", "gap2.return", "", "return", "")]
    gaps = [("map", "gap1", "id"), ("filter", "gap1", "make"), ("twice", "gap1", "id"), ("twice", "gap2", "id")]
    prog = t.with_models(
        t.compiled(stmts, flow, params), stmts, spark.createDataFrame(models, "callee string, base string, path string, to string, to_path string"), spark.createDataFrame(gaps, "callee string, gap string, target string"),
        params, spark.createDataFrame([("clear", "base", "e")], "callee string, base string, path string"), fallback=True,
    )
    sinks = stmts.where("kind = 'sink'").select("method", "stmt", F.explode("args").alias("base"))
    found = t.reached(t.tabulated(prog, t.seeds(stmts.where("kind = 'source' AND method <> 'make'").selectExpr("method", "stmt", "lhs AS base"))), sinks)
    assert {r.method for r in found.collect()} == {name for name, (_, n) in programs.items() if n}


def test_matched_walks(spark):
    rng = random.Random(3)
    edges, calls = set(), set()
    for body in range(4):
        nodes = [body * 10 + i for i in range(5)]
        edges |= {(a, b) for a, b in zip(nodes, nodes[1:], strict=False)} | {tuple(sorted(rng.sample(nodes, 2))) for _ in range(2)}
        calls |= {(nodes[rng.randrange(1, 4)], rng.randrange(4) * 10)}
    succ, into = defaultdict(set), defaultdict(set)
    for a, b in edges:
        succ[a].add(b)
    for a, b in calls:
        into[a].add(b)

    def walks(path, stack, n, deepest, visits):
        last = path[-1]
        if not succ[last]:
            if not stack:
                yield tuple(path), n
                return
            nexts = [(x, stack[:-1], n) for x in succ[stack[-1]]]
        elif into[last] and len(stack) < deepest:
            nexts = [(x, [*stack, last], n + 1) for x in into[last]]
        else:
            nexts = [(x, stack, n) for x in succ[last]]
        for x, s, m in nexts:
            if path.count(x) < visits:
                yield from walks([*path, x], s, m, deepest, visits)

    frame = lambda rows: spark.createDataFrame(sorted(rows), "src long, dst long")
    starts = spark.createDataFrame([(b * 10,) for b in range(4)], "node long")
    for deepest, visits in ((0, 1), (1, 1), (2, 2)):
        want = sorted(w for b in range(4) for w in walks([b * 10], [], 0, deepest, visits))
        assert sorted((tuple(r.path), r.calls) for r in recursion.matched_walks(frame(edges), frame(calls), starts, deepest, visits).collect()) == want


def test_edges_and_blocks_of_code(spark):
    code = spark.createDataFrame(
        [("m", 1, "ASSIGN", None, None), ("m", 2, "IF", [5], None), ("m", 3, "CALL", None, 6), ("m", 4, "GOTO", [2], None), ("m", 5, "RETURN", None, None), ("m", 6, "THROW", None, 99), ("m", 7, "SWITCH", [1, 1, 200], None)],
        "method string, n int, kind string, targets array<int>, handler int",
    )
    assert {(r.src, r.dst, r.kind) for r in cfg.code_edges(code).collect()} == {(1, 2, "next"), (2, 3, "next"), (2, 5, "target"), (3, 4, "next"), (3, 6, "exception"), (4, 2, "target"), (7, 1, "target")}
    blocks, edges = cfg.code_blocks(code)
    assert {(r.block, r.low, r.high) for r in blocks.collect()} == {(1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 4, 4), (5, 5, 5), (6, 6, 6), (7, 7, 7)}
    assert {(r.block, r.succ) for r in edges.collect()} == {(1, 2), (2, 3), (2, 5), (3, 4), (3, 6), (4, 2), (7, 1)}


def test_a_static_joins_methods_without_calls(spark):
    programs = {
        "writer": ([st(1, "source", "x"), st(2, "assign", "static S.f", "x")], 0),
        "other_writer": ([st(1, "source", "x"), st(2, "assign", "static S.f", "x")], 0),
        "reader": ([st(1, "assign", "y", "static S.f"), st(2, "assign", "static S.g", "y"), st(3, "sink", args=["y"])], 2),
        "second": ([st(1, "assign", "static S.g"), st(2, "assign", "y", "static S.g"), st(3, "sink", args=["y"])], 2),
        "clean": ([st(1, "assign", "y", "static S.h"), st(2, "sink", args=["y"])], 0),
    }
    from pyspark.sql import functions as F

    stmts, flow, params = tables(spark, programs)
    prog = t.compiled(stmts, flow, params)
    sinks = stmts.where("kind = 'sink' AND method <> 'leak_static'").select("method", "stmt", F.explode("args").alias("base"))
    sources = t.seeds(stmts.where("kind = 'source' AND method <> 'make'").selectExpr("method", "stmt", "lhs AS base"))
    found = [r.method for r in t.reached(t.with_globals(prog, sources), sinks).collect()]
    assert {name: found.count(name) for name in programs} == {name: n for name, (_, n) in programs.items()}
    assert not t.reached(t.tabulated(prog, sources), sinks).collect()


def test_conditions_decide_sinks_in_called_methods(spark):
    """Branches go from their statement to the one two after it, and to the next."""
    programs = {
        "under": ([st(1, "source", "x"), st(2, "if", rhs="x"), st(3, "call", callee="tell"), st(4, "nop")], 1),
        "after": ([st(1, "source", "x"), st(2, "if", rhs="x"), st(3, "nop"), st(4, "call", callee="tell")], 0),
        "assigned": ([st(1, "source", "x"), st(2, "if", rhs="x"), st(3, "assign", "y"), st(4, "sink", args=["y"])], 1),
        "nested": ([st(1, "source", "x"), st(2, "if", rhs="x"), st(3, "if", rhs="z"), st(4, "call", callee="pass_on"), st(5, "nop"), st(6, "nop")], 1),
        "untainted": ([st(1, "source", "x"), st(2, "if", rhs="z"), st(3, "call", callee="tell"), st(4, "nop")], 0),
    }
    helpers = {"tell": ([], [st(1, "sink", args=["c"])]), "pass_on": ([], [st(1, "nop"), st(2, "call", callee="tell")])}
    from pyspark.sql import functions as F

    hits = {}
    for name, (body, want) in programs.items():  # one program each, as they share the sink
        held = {name: ([], body)} | helpers
        stmts = spark.createDataFrame([(m, *s) for m, (_, rows) in held.items() for s in rows], taint.STATEMENT)
        flow = [(m, a[0], z[0]) for m, (_, rows) in held.items() for a, z in zip(rows, rows[1:], strict=False)]
        flow += [(name, s[0], s[0] + (3 if name == "nested" and s[0] == 2 else 2)) for s in body if s[1] == "if"]
        flow = spark.createDataFrame(flow, "method string, src long, dst long")
        params = spark.createDataFrame([(m, n) for m, (n, _) in held.items()], "method string, names array<string>")
        prog, decided = t.with_implicit(t.compiled(stmts, flow, params), stmts)
        sinks = stmts.where("kind = 'sink'").select("method", "stmt", F.explode("args").alias("base")).unionByName(decided)
        hits[name] = t.reached(t.tabulated(prog, t.seeds(stmts.where("kind = 'source'").selectExpr("method", "stmt", "lhs AS base"))), sinks).select("stmt", "origin").distinct().count()
    assert hits == {name: n for name, (_, n) in programs.items()}


def test_secondary_flows_gate_sinks(spark):
    """Sinks o.write(x): what o comes from decides, also through a callee and past a callee's start."""
    programs = {
        "from_net": ([st(1, "assign", "o"), st(2, "source", "x"), st(3, "sink", base="o", args=["x"])], ["net"], [], 1),
        "from_file": ([st(1, "assign", "o"), st(2, "source", "x"), st(3, "sink", base="o", args=["x"])], ["net"], [], 0),
        "copied": ([st(1, "assign", "n"), st(2, "assign", "o", "n"), st(3, "source", "x"), st(4, "sink", base="o", args=["x"])], ["net"], [], 1),
        "through_callee": ([st(1, "assign", "n"), st(2, "call", "o", callee="same", args=["n"]), st(3, "source", "x"), st(4, "sink", base="o", args=["x"])], ["net"], [], 1),
        "wrong_and_right": ([st(1, "assign", "o"), st(2, "source", "x"), st(3, "sink", base="o", args=["x"])], ["net", "file"], ["net"], 0),
        "made_anew": ([st(1, "assign", "o"), st(2, "assign", "o"), st(3, "source", "x"), st(4, "sink", base="o", args=["x"])], ["net"], [], 0),
        "none_wanted": ([st(1, "source", "x"), st(2, "sink", base="o", args=["x"])], [], ["net"], 1),
        "no_context": ([st(1, "source", "x"), st(2, "sink", base="o", args=["x"])], ["net"], [], 0),
        "no_condition": ([st(1, "source", "x"), st(2, "sink", base="o", args=["x"])], None, None, 1),
        "not_tainted": ([st(1, "assign", "o"), st(2, "source", "z"), st(3, "sink", base="o", args=["x"])], ["net"], [], 0),
    }
    from pyspark.sql import functions as F

    stmts = [(n, *s) for n, (body, *_) in programs.items() for s in body] + [("same", *st(1, "return", rhs="a"))]
    flow = [(n, a[0], z[0]) for n, (body, *_) in programs.items() for a, z in zip(body, body[1:], strict=False)]
    stmts = spark.createDataFrame(stmts, taint.STATEMENT)
    prog = t.compiled(stmts, spark.createDataFrame(flow, "method string, src long, dst long"), spark.createDataFrame([("same", ["a"])], "method string, names array<string>"))
    sinks = stmts.where("kind = 'sink'")
    at_sink = {n: body[-1][0] for n, (body, *_) in programs.items()}
    conditions = spark.createDataFrame([(n, at_sink[n], w, u) for n, (_, w, u, _) in programs.items() if w is not None], "method string, stmt long, wanted array<string>, unwanted array<string>")
    contexts = [(n, 1, programs[n][0][0][2], "file" if n == "from_file" else "net") for n in programs if programs[n][0][0][1] == "assign"]
    contexts = spark.createDataFrame(contexts, "method string, stmt long, base string, name string")
    sources = t.seeds(stmts.where("kind = 'source'").selectExpr("method", "stmt", "lhs AS base"))
    ask = lambda conditions, contexts: {r.method for r in t.gated(prog, sources, sinks.select("method", "stmt", F.explode("args").alias("base")), sinks.select("method", "stmt", "base"), contexts, conditions).collect()}
    assert ask(conditions, contexts) == {n for n, p in programs.items() if p[3]}
    assert ask(conditions.limit(0), contexts) == set(programs) - {"not_tainted"}
    assert ask(conditions, contexts.limit(0)) == {"none_wanted", "no_condition"}
