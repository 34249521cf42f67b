"""Conditions that guard calls: linear allocation graphs, constraints, paths and their formats.

A constraint is a struct (kind, method, ordinal, variable, operator, value, branch, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailhead.functions import text as t

CONDITIONS = ("IF_CONDITION", "SWITCH")


def allocation_graph(stmts: DataFrame) -> DataFrame:
    """Statements in textual order with the kinds before and after, bracketed by ENTRY and EXIT."""
    order = Window.partitionBy("method").orderBy("ordinal")
    return stmts.select(
        "method", "ordinal", "stmt_id", "kind", F.coalesce(F.lag("stmt_id").over(order).cast("string"), F.lit("ENTRY")).alias("pred"),
        F.coalesce(F.lead("stmt_id").over(order).cast("string"), F.lit("EXIT")).alias("succ"),
    )


def predecessor_condition(stmts: DataFrame) -> DataFrame:
    """Each statement with the nearest earlier condition of its method."""
    before = Window.partitionBy("method").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(F.col("kind").isin(*CONDITIONS), F.col("stmt_id")), ignorenulls=True).over(before)
    return stmts.withColumn("condition", found)


def call_constraints(stmts: DataFrame) -> DataFrame:
    """(method, stmt_id, callee, constraints): every earlier condition of a call, in textual order."""
    before = Window.partitionBy("method").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    made = F.collect_list(F.when(F.col("kind").isin(*CONDITIONS), F.struct("ordinal", "stmt_id", "kind"))).over(before)
    return stmts.withColumn("constraints", made).where("kind = 'METHOD_CALL'").select("method", "stmt_id", "ordinal", "callee", "constraints")


def build(conditions: DataFrame, use_branch: bool = False) -> DataFrame:
    """Constraint columns for condition rows (kind, raw, branch, case_value).

    Branches count as taken unless use_branch; switch constraints have the constant variable
    and case that path building gives them.
    """
    branch = F.coalesce("branch", F.lit(True)) if use_branch else F.lit(True)
    text = F.when(F.col("kind") == "SWITCH", t.fallback_switch(F.lit("case_value"), F.lit(False))).otherwise(t.fallback_condition("raw", branch))
    parsed = t.condition(text, "raw")
    switch = F.col("kind") == "SWITCH"
    return conditions.withColumn("taken", branch).withColumn("text", text).withColumn("parsed", parsed).select(
        *conditions.columns, "taken", "text", F.when(switch, t.switch_variable("text")).otherwise(F.col("parsed.variable")).alias("variable"),
        F.when(~switch, F.col("parsed.operator")).alias("operator"), F.when(switch, F.lit("case_value")).otherwise(F.col("parsed.value")).alias("value"),
    )


def conflict(a: Column, b: Column) -> Column:
    """Whether two constraint structs of one path contradict each other.

    Conditionals conflict on equal variable, operator and value with different branches;
    switches on one variable with different cases; parameters on one method and index, and
    fields on one object and field, with different values; component constraints never do.
    """
    same = a["kind"] == b["kind"]
    eq = lambda name: a[name].eqNullSafe(b[name])
    return same & (
        F.when(a["kind"] == "CONDITIONAL", eq("variable") & eq("operator") & eq("value") & ~eq("branch"))
        .when(a["kind"] == "SWITCH", eq("variable") & ~eq("value"))
        .when(a["kind"] == "PARAMETER", eq("method") & eq("variable") & ~eq("value"))
        .when(a["kind"] == "FIELD", eq("variable") & eq("operator") & ~eq("value"))
        .otherwise(False)
    )


def validated(paths: DataFrame) -> DataFrame:
    """paths (path_id, methods, constraints) with valid and reason.

    Pairs of a path are compared inside its own array, so nothing is shuffled; a path has
    few constraints, as they come from one chain of callers.
    """
    c = F.col("constraints")
    pairs = F.exists(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), lambda i: F.exists(F.slice(c, i + 1, F.greatest(F.size(c), F.lit(1))), lambda y: conflict(F.try_element_at(c, i), y)))
    blank = F.exists(c, lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) == "")
    reason = F.when(F.size("methods") == 0, "empty method sequence").when(blank, "blank constraint").when((F.size(c) > 1) & pairs, "incompatible constraints")
    return paths.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def combined(constraints: str | Column, field: str = "text") -> Column:
    c = F.col(constraints) if isinstance(constraints, str) else constraints
    return t.joined(F.transform(c, lambda x: x[field]), "AND")


def logical_expression(constraints: str) -> Column:
    """'true' for none; else the conjunction of each method's conjunction, methods in order of first appearance."""
    c = F.col(constraints)
    methods = F.array_distinct(F.transform(c, lambda x: x["method"]))
    grouped = F.transform(methods, lambda m: t.joined(F.transform(F.filter(c, lambda x: x["method"] == m), lambda x: x["text"]), "AND"))
    return F.when(F.size(c) == 0, "true").otherwise(t.joined(grouped, "AND"))


def disjunction(paths: DataFrame, by: str) -> DataFrame:
    """For each target the valid paths' expressions joined by OR; 'false' without any."""
    parts = F.array_sort(F.collect_list(F.when(F.col("valid"), F.struct("path_id", "expression"))))
    made = paths.groupBy(by).agg(parts.alias("parts"))
    text = t.joined(F.transform("parts", lambda x: x["expression"]), "OR")
    return made.select(by, F.when(F.size("parts") == 0, "false").otherwise(text).alias("expression"))


def common(paths: DataFrame, by: str, item: str) -> DataFrame:
    """Items of the array column that every path of a group has."""
    size = paths.groupBy(by).agg(F.count_distinct("path_id").alias("n"))
    seen = paths.select(by, "path_id", F.explode(item).alias("item")).distinct().groupBy(by, "item").agg(F.count("*").alias("k"))
    return seen.join(size, by).where("k = n").select(by, "item")


def merged(first: Column, second: Column) -> Column:
    """Ordered union of two method sequences."""
    return F.array_distinct(F.concat(first, second))
