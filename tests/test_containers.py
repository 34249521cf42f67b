"""Lists and maps within the solver: places, keys, widening in loops, and walks by brute force."""

import random

import pytest

from tests.test_taint import st
from trailhead.operators import taint
from trailhead.operators import tabulation as t

OPS = "method string, stmt long, base string, kind string, op string, at string, value string, lhs string"


def put(n, op, at, value="x", base="l", kind="list"):
    return (n, base, kind, op, at, value, None)


def get(n, at, lhs="y", base="l", kind="list", op="get"):
    return (n, base, kind, op, at, None, lhs)


def key(n, op, at, value="x"):
    return put(n, op, at, value, "m", "map")


#: name: operations after the source of x in statement 0, further edges, and whether y is tainted at the end
PROGRAMS = {
    "same_place": ([put(1, "append", "0"), get(2, "0")], [], True),
    "other_place": ([put(1, "append", "1"), get(2, "0")], [], False),
    "moved_up": ([put(1, "append", "0"), put(2, "add", "0", None), get(3, "1")], [], True),
    "moved_away": ([put(1, "append", "0"), put(2, "add", "0", None), get(3, "0")], [], False),
    "moved_down": ([put(1, "append", "1"), put(2, "remove", "0", None), get(3, "0")], [], True),
    "taken_out": ([put(1, "append", "0"), put(2, "remove", "0", None), get(3, "0")], [], False),
    "taken_to_y": ([put(1, "append", "0"), get(2, "0", op="remove")], [], True),
    "overwritten": ([put(1, "append", "0"), put(2, "set", "0", None), get(3, "0")], [], False),
    "perhaps_overwritten": ([put(1, "append", None), put(2, "set", "0", None), get(3, "0")], [], True),
    "unknown_read": ([put(1, "append", "3"), get(2, None)], [], True),
    "unknown_add": ([put(1, "append", "0"), put(2, "add", None, None), get(3, "1")], [], True),
    "unknown_add_below": ([put(1, "append", "1"), put(2, "add", None, None), get(3, "0")], [], False),
    "unknown_remove": ([put(1, "append", "2"), put(2, "remove", None, None), get(3, "1")], [], True),
    "cleared": ([put(1, "append", "0"), put(2, "clear", None, None), get(3, "0")], [], False),
    "clean_read_again": ([put(1, "append", "0"), get(2, "0"), get(3, "1")], [], False),
    "in_a_list_of_lists": ([put(1, "append", "0"), put(2, "append", "1", "l", "k"), get(3, "1", "z", "k"), get(4, "0", "y", "z")], [], True),
    "in_another_list": ([put(1, "append", "0"), put(2, "append", "1", "l", "k"), get(3, "0", "z", "k"), get(4, "0", "y", "z")], [], False),
    "loop_of_adds": ([put(1, "append", "0"), put(2, "add", "0", None), get(3, "7")], [(2, 2)], True),
    "loop_of_removes": ([put(1, "append", "9"), put(2, "remove", "0", None), get(3, "2")], [(2, 2)], True),
    "loop_of_removes_above": ([put(1, "append", "9"), put(2, "remove", "0", None), get(3, "12")], [(2, 2)], True),
    "once_round": ([put(1, "append", "0"), put(2, "add", "0", None), get(3, "7")], [], False),
    "same_key": ([key(1, "set", "a.b"), get(2, "a.b", base="m", kind="map")], [], True),
    "other_key": ([key(1, "set", "a.b"), get(2, "a", base="m", kind="map")], [], False),
    "unknown_key": ([key(1, "set", None), get(2, "a", base="m", kind="map")], [], True),
    "any_key_read": ([key(1, "set", "a"), get(2, None, base="m", kind="map")], [], True),
    "key_replaced": ([key(1, "set", "a"), key(2, "set", "a", None), get(3, "a", base="m", kind="map")], [], False),
    "key_removed": ([key(1, "set", "a"), key(2, "remove", "a", None), get(3, "a", base="m", kind="map")], [], False),
    "map_cleared": ([key(1, "set", "a"), key(2, "clear", None, None), get(3, "a", base="m", kind="map")], [], False),
}


def program(spark):
    stmts, flow, ops = [], [], []
    for name, (body, more, _) in PROGRAMS.items():
        last = len(body) + 1
        stmts += [(name, *st(0, "source", "x")), *((name, *st(n, "nop")) for n in range(1, last)), (name, *st(last, "sink", args=["y"]))]
        flow += [(name, n, n + 1) for n in range(last)] + [(name, a, z) for a, z in more]
        ops += [(name, *o) for o in body]
    stmts = spark.createDataFrame(stmts, taint.STATEMENT)
    none = spark.createDataFrame([], "method string, names array<string>")
    return t.compiled(stmts, spark.createDataFrame(flow, "method string, src long, dst long"), none), spark.createDataFrame(ops, OPS), stmts


def found(prog, stmts):
    sources = t.seeds(stmts.where("kind = 'source'").selectExpr("method", "stmt", "lhs AS base"))
    return {r.method for r in t.reached(t.tabulated(prog, sources), stmts.where("kind = 'sink'").selectExpr("method", "stmt", "'y' AS base")).collect()}


def test_places_and_keys(spark):
    prog, ops, stmts = program(spark)
    assert found(t.with_containers(prog, ops), stmts) == {n for n, p in PROGRAMS.items() if p[2]}


def test_widening_and_smashing(spark):
    prog, ops, stmts = program(spark)
    want = {n for n, p in PROGRAMS.items() if p[2]}
    assert found(t.with_containers(prog, ops, "shift"), stmts) == want | {"moved_away", "once_round", "unknown_add_below"}
    assert found(t.with_containers(prog, ops, "none"), stmts) == want - {"loop_of_removes_above"}
    cleared = {"cleared", "map_cleared", "clean_read_again"}
    assert found(t.with_containers(prog, ops, smash=True), stmts) >= set(PROGRAMS) - cleared
    with pytest.raises(ValueError):
        t.with_containers(prog, ops, "never")


def test_no_operations(spark):
    prog, ops, stmts = program(spark)
    assert found(t.with_containers(prog, ops.limit(0)), stmts) == set()


def test_moves_against_lists():
    """An interval covers all places that a value may be at, whatever the operations did."""
    rng = random.Random(5)
    for _ in range(500):
        at = rng.randrange(4)
        places, field = {at}, f"#{at}"
        for _ in range(rng.randrange(6)):
            where, by = rng.choice([None, 0, 1, 2, 3]), rng.choice([1, -1])
            known = range(8) if where is None else [where]
            if by > 0:
                places = {p + (p >= w) for p in places for w in known}
            else:
                places = {p - (p > w) for p in places for w in known if p != w}
            if not places:
                break
            field = t.moved(field, where, by)
            assert field is not None
            low, high = t._interval(field)
            assert low <= min(places) and max(places) <= high
            if where is not None and low == high:
                assert places == {low}


def test_a_callee_that_moves_a_list_in_recursion_ends(spark):
    """The list comes back from each call one place further on, until its places are opened."""
    stmts = [("main", *st(1, "source", "x")), ("main", *st(2, "nop")), ("main", *st(3, "call", callee="push", args=["l"])), ("main", *st(4, "nop")), ("main", *st(5, "sink", args=["y"])), ("push", *st(11, "nop"))]
    stmts = spark.createDataFrame(stmts, taint.STATEMENT)
    flow = spark.createDataFrame([("main", 1, 2), ("main", 2, 3), ("main", 3, 3), ("main", 3, 4), ("main", 4, 5)], "method string, src long, dst long")
    ops = spark.createDataFrame([("main", *put(2, "append", "0")), ("main", *get(4, "3")), ("push", *put(11, "add", "0", None))], OPS)
    prog = t.compiled(stmts, flow, spark.createDataFrame([("push", ["l"])], "method string, names array<string>"))
    assert found(t.with_containers(prog, ops, most=4), stmts) == {"main"}


def test_backwards_gives_the_same(spark):
    """But for a place that is surely overwritten, which only shows backwards, as there it is known."""
    prog, ops, stmts = program(spark)
    prog = t.with_containers(prog, ops)
    sinks, sources = stmts.where("kind = 'sink'").selectExpr("method", "stmt", "'y' AS base"), stmts.where("kind = 'source'").selectExpr("method", "stmt", "lhs AS base")
    back = t.reached(t.tabulated(t.converse(prog).written(), t.seeds(sinks)), sources)
    assert {r.method for r in back.collect()} == {n for n, p in PROGRAMS.items() if p[2]} - {"perhaps_overwritten"}
