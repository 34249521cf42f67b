"""Control flow of methods given as statements (method, ordinal, kind, callee)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far a taken branch of each kind jumps.
JUMPS = {"IF_CONDITION": 3, "SWITCH": 2}
BRANCHES = tuple(JUMPS)


def flow_edges(stmts: DataFrame, jumps: dict[str, int] | None = None) -> DataFrame:
    """(method, src, dst): the next statement, and for branches the jump target where there is one.

    Targets come from the statements' own numbers, so nothing is joined: one window gives
    each method's last ordinal.
    """
    jumps = JUMPS if jumps is None else jumps
    last = F.max("ordinal").over(Window.partitionBy("method"))
    reach = F.array(F.lit(1), *(F.when(F.col("kind") == k, F.lit(n)) for k, n in jumps.items()))
    step = stmts.withColumn("last", last).select("method", "ordinal", "last", F.explode(F.array_distinct(F.array_compact(reach))).alias("step"))
    step = step.where(F.col("ordinal") + F.col("step") <= F.col("last"))
    return step.select("method", F.col("ordinal").cast("long").alias("src"), (F.col("ordinal") + F.col("step")).cast("long").alias("dst"))


def numbered(stmts: DataFrame) -> DataFrame:
    """Statements with the number of their basic block.

    A statement leads a block if it is the first, follows a branch or is a branch's target. A
    target lies a known distance after its branch, so one window over the method tells all three.
    """
    order = Window.partitionBy("method").orderBy("ordinal")
    leader = (F.col("ordinal") == 1) | F.lag("kind").over(order).isin(*BRANCHES)
    for kind, step in JUMPS.items():
        leader = leader | (F.coalesce(F.lag("kind", step).over(order), F.lit("")) == kind)
    made = stmts.withColumn("leader", F.when(leader, 1).otherwise(0))
    return made.withColumn("block", F.sum("leader").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def _parts(stmts: DataFrame):
    rows = numbered(stmts)
    order = Window.partitionBy("method").orderBy("ordinal")
    # the block of the next statement and of a taken branch's target, looked up in the same window
    ahead = [F.lead("block").over(order), *(F.when(F.col("kind") == k, F.lead("block", n).over(order)) for k, n in JUMPS.items())]
    reach = rows.withColumn("ahead", F.array_compact(F.array(*ahead)))
    last = F.max_by("ahead", "ordinal")
    spans = reach.groupBy("method", "block").agg(F.count("*").alias("n_units"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), last.alias("ahead"))
    jumps = spans.select("method", "block", F.explode(F.array_distinct("ahead")).alias("succ"))
    return rows, spans.drop("ahead"), jumps


def blocks(stmts: DataFrame) -> DataFrame:
    """(method, block, n_units, is_entry, is_exit, succ)."""
    _, spans, jumps = _parts(stmts)
    succ = jumps.groupBy("method", "block").agg(F.sort_array(F.collect_list("succ")).alias("succ"))
    made = spans.join(succ, ["method", "block"], "left")
    return made.select(
        "method", "block", "n_units", (F.col("low") == 1).alias("is_entry"), F.col("succ").isNull().alias("is_exit"), F.coalesce("succ", F.array().cast("array<int>")).alias("succ")
    )


def interprocedural(stmts: DataFrame) -> DataFrame:
    """(src_method, src_block, dst_method, dst_block, kind): successors, calls and returns.

    A call returns to its own block if statements follow there, else to the least successor.
    """
    rows, spans, jumps = _parts(stmts)
    known = stmts.select(F.col("method").cast("long").alias("callee")).distinct()
    calls = rows.where("kind = 'METHOD_CALL'").select("method", "block", "ordinal", F.col("callee").cast("long").alias("callee")).join(known, "callee", "left_semi")
    calls = calls.join(spans.select("method", "block", "high"), ["method", "block"])
    exits = spans.join(jumps, ["method", "block"], "left_anti").select(F.col("method").alias("callee"), F.col("block").alias("exit"))
    least = jumps.groupBy("method", "block").agg(F.min("succ").alias("least"))
    back = calls.join(least, ["method", "block"], "left").withColumn("cont", F.when(F.col("ordinal") < F.col("high"), F.col("block")).otherwise(F.col("least"))).where("cont IS NOT NULL")
    edge = lambda df, a, m, c, n, kind: df.select(F.col(a).alias("src_method"), F.col(m).alias("src_block"), F.col(c).alias("dst_method"), F.lit(1).alias("dst_block") if n is None else F.col(n).alias("dst_block"), F.lit(kind).alias("kind")).distinct()
    return (
        edge(jumps, "method", "block", "method", "succ", "succ")
        .unionByName(edge(calls, "method", "block", "callee", None, "call"))
        .unionByName(edge(back.join(exits, "callee"), "callee", "exit", "method", "cont", "return"))
    )


#: Statements that never go on to the next one, and those after which a block ends.
LEAVING = ("GOTO", "RETURN", "THROW")
ENDING = (*LEAVING, "IF", "SWITCH", "CALL")


def code_edges(code: DataFrame) -> DataFrame:
    """(method, src, dst, kind) of code (method, n, kind, targets, handler): next statement, targets of branches, and handlers of exceptions.

    Targets are data: any statements of the method, before or after the branch. A call or
    throw under a handler may go there. Targets outside the method lead nowhere.
    """
    leaving = ", ".join(f"'{k}'" for k in LEAVING)
    step = "named_struct('dst', {}, 'kind', '{}')".format
    each = f"""concat(IF(kind IN ({leaving}), array(), array({step('n + 1', 'next')})), transform(coalesce(targets, array()), t -> {step('t', 'target')}),
      IF(kind IN ('CALL', 'THROW') AND handler IS NOT NULL, array({step('handler', 'exception')}), array()))"""
    rows = code.withColumn("last", F.max("n").over(Window.partitionBy("method"))).selectExpr("method", "n AS src", "last", f"explode({each}) AS e")
    return rows.where("e.dst BETWEEN 1 AND last").select("method", "src", "e.dst", "e.kind").distinct()


def code_blocks(code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (method, block, low, high) of code, and their edges (method, block, succ).

    A block begins at the first statement, at every target and handler, and after a branch,
    call or end. An exception may leave a block at any statement of it.
    """
    edges = code_edges(code)
    led = edges.where("kind <> 'next'").select("method", F.col("dst").alias("n")).distinct().withColumn("led", F.lit(True))
    order = Window.partitionBy("method").orderBy("n")
    leader = (F.col("n") == 1) | F.col("led").isNotNull() | F.lag("kind").over(order).isin(*ENDING)
    rows = code.select("method", "n", "kind").join(led, ["method", "n"], "left").withColumn("leader", leader)
    rows = rows.withColumn("block", F.sum(F.col("leader").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    blocks = rows.groupBy("method", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    from_ = rows.select("method", F.col("n").alias("src"), "block")
    to = rows.where("leader").select("method", F.col("n").alias("dst"), F.col("block").alias("succ"))
    return blocks, edges.join(from_, ["method", "src"]).join(to, ["method", "dst"]).select("method", "block", "succ").distinct()
