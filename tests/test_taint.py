"""Micro-programs with fixed numbers of flows."""

import pytest

from trailhead.operators import taint


def st(n, kind, lhs=None, rhs=None, lf=None, rf=None, callee=None, base=None, args=(), type_=None):
    return (n, kind, lhs, lf, rhs, rf, callee, base, list(args), type_)


PROGRAMS = {
    "direct": ([st(1, "source", "x"), st(2, "sink", args=["x"])], 1),
    "overwrite": ([st(1, "source", "x"), st(2, "assign", "x"), st(3, "sink", args=["x"])], 0),
    "field": ([st(1, "source", "x"), st(2, "assign", "a", "x", lf="f"), st(3, "assign", "y", "a", rf="f"), st(4, "sink", args=["y"])], 1),
    "field_other": ([st(1, "source", "x"), st(2, "assign", "a", "x", lf="f"), st(3, "assign", "y", "a", rf="g"), st(4, "sink", args=["y"])], 0),
    "alias": ([st(1, "assign", "b", "a"), st(2, "source", "x"), st(3, "assign", "a", "x", lf="f"), st(4, "assign", "y", "b", rf="f"), st(5, "sink", args=["y"])], 1),
    "array_element": ([st(1, "source", "x"), st(2, "assign", "r", "x", lf="[]"), st(3, "assign", "y", "r", rf="[]"), st(4, "sink", args=["y"])], 1),
    "array_length": ([st(1, "source", "x"), st(2, "assign", "r", "x", lf="[]"), st(3, "assign", "y", "r", rf="len"), st(4, "sink", args=["y"])], 0),
    "call_context": ([st(1, "source", "x"), st(2, "call", "a", callee="id", args=["x"]), st(3, "assign", "c"), st(4, "call", "b", callee="id", args=["c"]), st(5, "sink", args=["b"])], 0),
    "call_return": ([st(1, "source", "x"), st(2, "call", "a", callee="id", args=["x"]), st(3, "sink", args=["a"])], 1),
    "callee_source": ([st(1, "call", "a", callee="make"), st(2, "sink", args=["a"])], 1),
    "heap_argument": ([st(1, "source", "x"), st(2, "call", callee="put", args=["o", "x"]), st(3, "assign", "y", "o", rf="v"), st(4, "sink", args=["y"])], 1),
    "static": ([st(1, "source", "x"), st(2, "assign", "static S.f", "x"), st(3, "call", callee="leak_static")], 1),
    "exception": ([st(1, "source", "x"), st(2, "throw", rhs="x"), st(3, "catch", "e"), st(4, "sink", args=["e"])], 1),
    "implicit": ([st(1, "source", "x"), st(2, "if", rhs="x"), st(3, "assign", "y"), st(4, "sink", args=["y"])], 0),
    "wrapper": ([st(1, "source", "x"), st(2, "call", callee="List.add", base="l", args=["x"]), st(3, "call", "y", callee="List.get", base="l"), st(4, "sink", args=["y"])], 1),
    "wrapper_clear": ([st(1, "source", "x"), st(2, "call", callee="List.add", base="l", args=["x"]), st(3, "call", callee="List.clear", base="l"), st(4, "call", "y", callee="List.get", base="l"), st(5, "sink", args=["y"])], 0),
    "bad_cast": ([st(1, "source", "x"), st(2, "cast", "y", "x", rf="String", type_="Integer"), st(3, "sink", args=["y"])], 0),
    "good_cast": ([st(1, "source", "x"), st(2, "cast", "y", "x", rf="String", type_="Object"), st(3, "sink", args=["y"])], 1),
    "recursion": ([st(1, "source", "x"), st(2, "call", "a", callee="again", args=["x"]), st(3, "sink", args=["a"])], 1),
    "two_sources": ([st(1, "source", "x"), st(2, "source", "y"), st(3, "sink", args=["x", "y"])], 2),
    "deep": ([st(1, "source", "x"), *[st(i, "assign", f"a{i}", "x" if i == 2 else f"a{i - 1}", lf="f") for i in range(2, 10)], st(10, "assign", "y", "a9", rf="f"), st(11, "sink", args=["y"])], 1),
}
HELPERS = {
    "id": (["p"], [st(1, "return", rhs="p")]),
    "make": ([], [st(1, "source", "s"), st(2, "return", rhs="s")]),
    "put": (["o", "v"], [st(1, "assign", "o", "v", lf="v"), st(2, "return")]),
    "leak_static": ([], [st(1, "assign", "z", "static S.f"), st(2, "sink", args=["z"])]),
    "again": (["p"], [st(1, "if", rhs="p"), st(2, "call", "q", callee="again", args=["p"]), st(3, "return", rhs="p")]),
}
WRAPPERS = {
    "List.add": {"flows": [("arg0", (), "base", ("elements",))]},
    "List.get": {"flows": [("base", ("elements",), "return", ())]},
    "List.clear": {"flows": [], "kill": [("base", ("elements",))]},
}
RULES = {"wrappers": WRAPPERS, "casts": {("String", "Object")}}


def program(spark):
    stmts, cfg, params, offset, sinks = [], [], [], 0, {}
    for name, (names, body) in [*((n, ([], b)) for n, (b, _) in PROGRAMS.items()), *HELPERS.items()]:
        offset += 100
        params.append((name, names))
        stmts += [(name, offset + s[0], *s[1:]) for s in body]
        cfg += [(name, offset + a[0], offset + b[0]) for a, b in zip(body, body[1:], strict=False)]
        for a, c in ((2, 4),) if name == "implicit" else ((1, 3),) if name == "again" else ():
            cfg.append((name, offset + a, offset + c))
        sinks[name] = offset
    return spark.createDataFrame(stmts, taint.STATEMENT), spark.createDataFrame(cfg, "method string, src long, dst long"), spark.createDataFrame(params, "method string, names array<string>")


@pytest.fixture(scope="module")
def found(spark):
    stmts, cfg, params = program(spark)
    roots = spark.createDataFrame([(n,) for n in PROGRAMS], "method string")
    rows = taint.flows(stmts, cfg, params, roots, taint.Rules(**RULES)).collect()
    implicit = taint.flows(stmts, cfg, params, roots, taint.Rules(implicit=True, **RULES)).collect()
    no_statics = taint.flows(stmts, cfg, params, roots, taint.Rules(statics=False, **RULES)).collect()
    return rows, implicit, no_statics


@pytest.mark.parametrize("name", PROGRAMS)
def test_number_of_flows(found, name):
    where = "leak_static" if name == "static" else name
    assert len({(r["sink"], r["source"]) for r in found[0] if r["method"] == where}) == PROGRAMS[name][1]


def test_implicit_flows_are_an_option(found):
    assert len([r for r in found[1] if r["method"] == "implicit"]) == 1
    assert not [r for r in found[2] if r["method"] == "leak_static"]


def test_entailed_facts_and_conditions(spark):
    flows = spark.createDataFrame([("m", 1, 9, "x"), ("m", 1, 9, "x.f"), ("m", 1, 9, "xy.f"), ("m", 2, 9, "x.f")], "method string, sink long, source long, fact string")
    assert {tuple(r) for r in taint.without_entailed(flows).collect()} == {("m", 1, 9, "x"), ("m", 1, 9, "xy.f"), ("m", 2, 9, "x.f")}
    conditions = spark.createDataFrame([(1, ["open"], ["Base"], []), (2, ["open"], [], ["Bad"])], "sink long, signatures array<string>, classes array<string>, excluded array<string>")
    above = spark.createDataFrame([("Derived", "Base"), ("Worse", "Bad")], "sub string, sup string")
    pairs = flows.dropDuplicates(["sink"]).select("source", "sink")

    def kept(*reached):
        rows = spark.createDataFrame(list(reached), "source long, sink long, sig string, class string")
        return sorted(r["sink"] for r in taint.conditional(pairs, conditions, rows, above).collect())

    assert kept((9, 1, "open", "Derived"), (9, 2, "open", "Other")) == [1, 2]
    assert kept((9, 1, "open", "Other"), (9, 2, "open", "Worse")) == []
    assert kept((9, 1, "close", "Derived")) == []


def test_generated_summaries(spark):
    stmts, cfg, params = program(spark)
    rows = {(r["method"], r["from_param"], r["to"], r["fields"]) for r in taint.generated(stmts, cfg, params, taint.Rules(**RULES)).collect()}
    assert rows == {("id", 0, "Return", ""), ("put", 1, "Parameter 0", "v"), ("again", 0, "Return", "")}
