"""Extractors: questions, answers that fail, and what rules say."""

import re

from trailhead.operators import extraction as x


def _sites(spark, *rows):
    return spark.createDataFrame(rows, x.SITE)


def _bodies(spark):
    methods = spark.createDataFrame([("m", "<A: void m(int)>", ["int"]), ("e", "<A: void e()>", None)], "method string, sig string, params array<string>")
    return x.bodies(methods, spark.createDataFrame([("m", 2, "if $i0 gt 1"), ("m", 1, "$i0 := @p0"), ("m", 3, None)], "method string, at int, text string"))


def test_prompts_have_whole_methods_unless_bounded(spark):
    bodies = _bodies(spark)
    assert {r.method: r.body for r in bodies.collect()} == {"m": "<A: void m(int)>\ntakes p0: int\n$i0 := @p0\nif $i0 gt 1\n", "e": x.NO_BODY}
    sites = _sites(spark, ("m", 2, "single", "$i0 gt 1", "log()", None, None, None, None, None), ("gone", 1, "switch", "s", None, None, None, True, None, None))
    rows = sites.join(bodies, "method", "left")
    whole, short = ({r.kind: r.p for r in rows.select("kind", x.prompt(n).alias("p")).collect()} for n in (None, 5))
    assert "if $i0 gt 1" in whole["single"] and "Target: log()" in whole["single"] and "BUSINESS_CONSTRAINT_START" in whole["single"]
    assert x.NO_BODY in whole["switch"] and "Case: the default" in whole["switch"]
    assert "<A: v..." in short["single"] and "@p0" not in short["single"]


def test_each_question_is_asked_once_and_failures_fall_back(spark, tmp_path):
    log = str(tmp_path / "asked")

    def client():
        def ask(prompt):
            subject = re.search(r"(?:Condition|Argument \d|Variable): (.*)", prompt).group(1)
            with open(log, "a") as out:
                out.write(subject + "\n")
            if subject == "$bad":
                raise ValueError("no")
            return 'Answer: "the count"\nThis is why.' if subject == "$i1" else "  "

        return ask

    sites = _sites(
        spark, *[("m", n, "variable", "$i1", None, None, None, None, None, "int") for n in range(3)], ("m", 4, "variable", "$bad", None, None, None, None, None, "int"),
        ("m", 5, "parameter", "$bad", "c", None, None, None, 0, None), ("m", 6, "conditional", "$i2 eq 3", None, False, None, None, None, None), ("m", 7, "other", "s", None, None, None, None, None, None),
        (None, None, "conditional", None, None, None, None, None, None, None),
    )
    rows = x.extracted(sites, _bodies(spark), client, retries=2, wait=0.0).collect()
    assert sorted((r.site, r.text, r.from_model) for r in rows) == [
        (0, "the count", True), (1, "the count", True), (2, "the count", True), (4, "$bad".replace("$", "var_") + "_int", False), (6, "[!(var_i2 == 3)]", False)
    ]
    asked = open(log).read().split("\n")
    assert asked.count("$i1") == 1 and asked.count("$bad") == 4  # two questions, asked twice each
    assert {r.site: (r.variable, r.operator, r.value) for r in rows}[6] == ("var_i2", "==", "3")


def test_rules_and_nothing(spark):
    sites = _sites(
        spark, ("m", 1, "switch", "lookupswitch($i0)", None, None, "4", False, None, None), ("m", 2, "parameter", "$r1", "c", None, None, None, 0, None), ("m", 3, "parameter", "$z.f", "c", None, None, None, 1, None)
    )
    rows = x.extracted(sites, _bodies(spark)).collect()
    assert {(r.site, r.text, r.variable, r.value) for r in rows} == {(1, "[switch_var == 4]", "switch_var", "4"), (3, "param[1] = var_z.f", None, None)}
    assert x.extracted(sites.limit(0), _bodies(spark)).isEmpty()
