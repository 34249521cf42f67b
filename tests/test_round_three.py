"""Open list places, widening, unknown keys, blocks without definitions, gaps in a cycle, wrapper modes and caches."""

import os

import pytest

from trailhead.__main__ import main
from trailhead.operators import collections, frontend, summaries
from trailhead.sources import readers

OPS = "method string, var string, ordinal long, op string, at int, tainted boolean"


def leaks(df):
    return {r["ordinal"]: r["leak"] for r in df.collect()}


def ops(spark, *rows):
    return spark.createDataFrame([("m", "x", i, *r) for i, r in enumerate(rows)], OPS)


def test_unknown_places_of_lists(spark):
    rows = ops(spark, ("add", 0, True), ("add", None, False), ("get", 0, False), ("get", 1, False), ("get", 2, False), ("get", None, False), ("remove", None, False), ("get", 0, False), ("get", 2, False), ("set", 0, False), ("get", 0, False), ("clear", None, False), ("get", None, False))
    assert leaks(collections.list_reads(rows)) == {2: True, 3: True, 4: False, 5: True, 7: True, 8: False, 10: True, 12: False}


def test_an_unknown_place_taints_all_and_stays(spark):
    rows = ops(spark, ("add", None, True), ("set", 3, False), ("get", 3, False), ("remove", 0, False), ("add", 5, False), ("get", 900, False))
    assert leaks(collections.list_reads(rows)) == {2: True, 5: True}


def test_widening_opens_what_moves(spark):
    rows = ops(spark, ("add", 2, True), ("get", 9, False), ("add", 0, False), ("get", 9, False))
    assert leaks(collections.list_reads(rows, widen=True)) == {1: False, 3: True}
    assert leaks(collections.list_reads(rows)) == {1: False, 3: False}


def test_unknown_keys_of_maps(spark):
    rows = ops(spark, ("add", 1, True), ("get", None, False), ("get", 2, False), ("add", None, True), ("get", 2, False), ("add", 1, False), ("get", 1, False), ("clear", None, False), ("get", None, False))
    assert leaks(collections.map_reads(rows)) == {1: True, 2: False, 4: True, 6: True, 8: False}
    assert leaks(collections.map_reads(rows, smash=True)) == {1: True, 2: True, 4: True, 6: True, 8: False}
    assert collections.map_reads(rows.where("false")).count() == 0


def test_must_alias_without_definitions(spark):
    stmts = spark.createDataFrame([("m", 0, 1, "a", "b"), ("m", 0, 3, "b", None), ("m", 0, 5, None, None)], "method string, block long, ordinal long, lhs string, rhs string")
    asked = spark.createDataFrame([("m", 0, 2, "a", "b"), ("m", 0, 4, "a", "b"), ("m", 1, 2, "a", "b"), ("m", 1, 2, "a", "a")], "method string, block long, ordinal long, a string, b string")
    assert [(r["block"], r["ordinal"], r["must"]) for r in collections.must_alias(stmts, asked).orderBy("block", "ordinal", "must").collect()] == [(0, 2, True), (0, 4, False), (1, 2, False), (1, 2, True)]


def test_gaps_that_call_each_other_come_to_an_end(spark):
    flows = spark.createDataFrame([("m", "p0", None, "a0", "g1"), ("m", "r", "g1", "a0", "g2"), ("m", "r", "g2", "a0", "g1"), ("m", "r", "g2", "return", None), ("m", "p1", None, "a0", "g3")], "method string, src string, src_gap string, dst string, dst_gap string")
    bodies = spark.createDataFrame([("g1", "a0", "r"), ("g2", "a0", "r")], "gap string, src string, dst string")
    assert [tuple(r) for r in summaries.through_gaps(flows, bodies).collect()] == [("m", "p0", "return")]
    assert summaries.through_gaps(flows, bodies.where("false")).count() == 0


def test_unknown_modes_are_errors(spark):
    effects = spark.createDataFrame([(1, "a", "b")], "call long, source string, target string")
    with pytest.raises(ValueError):
        summaries.modelled("other", effects, summaries=effects)
    controls = spark.createDataFrame([(1, "v", False), (1, "v", True), (2, "v", False)], "id long, view string, sensitive boolean")
    lookups = spark.createDataFrame([("m", 1, 1), ("m", 2, 2), ("m", 3, 9)], "method string, stmt long, control_id long")
    assert {m: frontend.control_sources(lookups, controls, m).count() for m in ("none", "all", "sensitive")} == {"none": 0, "all": 2, "sensitive": 1}
    with pytest.raises(ValueError):
        frontend.control_sources(lookups, controls, "other")


def test_a_cache_without_its_mark_is_made_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert readers.cached(spark, path, lambda: spark.range(3)).count() == 3
    assert readers.cached(spark, path, lambda: spark.range(5)).count() == 3
    (tmp_path / "cache" / "_SUCCESS").unlink()
    assert readers.cached(spark, path, lambda: spark.range(5)).count() == 5


def test_command_line(spark, tmp_path, capsys):
    main(["list"])
    assert "bundle_types" in capsys.readouterr().out.split()
    main(["sql", "bundle_types"])
    assert "SELECT" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "no such query", "a", "b"])
    if os.path.isdir("/root/testdata/sf0.001"):
        main(["run", "bundle_types", "/root/testdata/sf0.001", str(tmp_path / "out")])
        assert spark.read.parquet(str(tmp_path / "out")).count() == 200
