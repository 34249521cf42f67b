"""Constraints in words, from a model where one answers and by rule where none does.

Five kinds of sites (method, site, kind, subject, target, branch, case_value, is_default, index, type):

    single        a condition before a target statement; the answer has a branch and three formats
    conditional   a condition of which one branch was taken
    switch        a case of a switch, or its default
    parameter     an argument of a call at index; without something to say there is no row
    variable      what a variable of a type stands for

Sites that ask the same are asked about once, over all methods' sites; the number of requests
therefore follows the number of different questions. A prompt has the whole text of the
method unless ``context`` bounds it. Bodies are joined to the different questions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhead.functions import text as t
from trailhead.operators import evaluation
from trailhead.storage import checkpointed

SITE = "method string, site long, kind string, subject string, target string, branch boolean, case_value string, is_default boolean, index int, type string"
#: What a question consists of.
_ASKED = ["method", "kind", "subject", "target", "branch", "case_value", "is_default", "index"]
NO_BODY = "(no body)"


def bodies(methods: DataFrame, statements: DataFrame) -> DataFrame:
    """(method, body) for methods (method, sig, params array) and statements (method, at, text): a line for each, in order."""
    lines = statements.groupBy("method").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("lines"))
    params = F.array_join(F.transform(F.coalesce("params", F.array().cast("array<string>")), lambda p, i: F.concat(F.lit("p"), i.cast("string"), F.lit(": "), p)), ", ")
    body = F.concat_ws("\n", "sig", F.concat(F.lit("takes "), params), F.array_join(F.transform("lines", lambda x: F.coalesce(x["text"], F.lit(""))), "\n"))
    return methods.join(lines, "method", "left").select("method", F.when(F.col("lines").isNotNull(), body).otherwise(NO_BODY).alias("body"))


def _marked(name: str, what: str) -> str:
    return f"{name}_START\n<{what}>\n{name}_END\n"


_FORMATS = (
    _marked("BRANCH_DIRECTION", "TRUE or FALSE: the branch that leads to the target") + _marked("BOOLEAN_CONSTRAINT", "an expression over names that say what they hold")
    + _marked("BUSINESS_CONSTRAINT", "what it means to a user, in a sentence") + _marked("TECHNICAL_CONSTRAINT", "the library methods it depends on and what they return")
)


def prompt(context: int | None = None) -> Column:
    """The question about a site, for rows with the columns of SITE and a body."""
    body = F.coalesce("body", F.lit(NO_BODY))
    body = body if context is None else F.when(F.length(body) > context, F.concat(F.substring(body, 1, context), F.lit("..."))).otherwise(body)
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    subject, frame = text("subject"), lambda *parts: say("[METHOD_BODY]\n", body, "\n[/METHOD_BODY]\n\n", *parts)
    branch = F.when(F.col("branch"), "TRUE").otherwise("FALSE")
    case = F.when(F.coalesce("is_default", F.lit(False)), "the default").otherwise(text("case_value"))
    return (
        F.when(F.col("kind") == "single", frame(
            "Condition: ", subject, "\nTarget: ", text("target"), "\n\nWhat must hold at the condition for the target to be executed? Go back to the last assignment of each variable in it, "
            "explain what library methods return, and name values by what they stand for. Then answer between these marks:\n\n", _FORMATS))
        .when(F.col("kind") == "conditional", frame("Condition: ", subject, "\nBranch taken: ", branch, "\n\nSay in one line what holds then. Only that line:"))
        .when(F.col("kind") == "switch", frame("Switch: ", subject, "\nCase: ", case, "\n\nSay in one line what holds then. Only that line:"))
        .when(F.col("kind") == "parameter", frame("Call: ", text("target"), "\nArgument ", text("index"), ": ", subject, "\n\nWhat must hold for the argument, if anything? Only one line:"))
        .otherwise(frame("Variable: ", subject, "\n\nWhat does the variable stand for? Only its meaning:"))
    )


def _by_rule() -> Column:
    """What is said about a site without a model."""
    return (
        F.when(F.col("kind") == "single", t.fallback_condition("subject", F.lit(True)))
        .when(F.col("kind") == "conditional", t.fallback_condition("subject", F.coalesce("branch", F.lit(False))))
        .when(F.col("kind") == "switch", t.fallback_switch("case_value", F.coalesce("is_default", F.lit(False))))
        .when(F.col("kind") == "parameter", t.fallback_parameter("subject", "index"))
        .otherwise(t.fallback_variable("type", "subject"))
    )


def extracted(sites: DataFrame, texts: DataFrame, client: Callable | None = None, retries: int = 3, wait: float = 1.0, context: int | None = None) -> DataFrame:
    """(method, site, kind, index, text, format1, format2, format3, branch, variable, operator, value, from_model) of each site.

    texts are bodies(). Without a client, and where an answer fails or can't be read, rules say
    what they can; but an argument about which a model failed has no row, nor has one of nothing but a register.
    Sites of other kinds have no row. Further columns of sites are ignored; rows that are the same are kept.
    """
    rows = sites.where(F.col("kind").isin("single", "conditional", "switch", "parameter", "variable")).select(*(c.split()[0] for c in SITE.split(", ")))
    rows = rows.withColumn("id", F.sha2(F.to_json(F.struct(*_ASKED)), 256))
    none = F.lit(None).cast("string")
    if client is None:
        rows = rows.withColumn("response", none)
    else:
        asked = rows.select("id", *_ASKED).distinct().join(texts.select("method", "body"), "method", "left").select("id", prompt(context).alias("prompt"))
        answers = checkpointed(evaluation.asked(asked, client, retries, wait))  # each question is asked once
        rows = rows.join(answers.select("id", F.when(F.col("success"), F.col("response")).alias("response")), "id", "left")
    one = F.col("kind") == "single"
    line = F.nullif(t.clean_response("response"), F.lit(""))
    rows = rows.withColumn("s", F.when(one, t.structured_response("response"))).withColumn("line", F.when(~one & F.col("response").isNotNull(), line))
    said = F.coalesce(F.col("s.format1"), F.col("line"))
    rule = _by_rule() if client is None else F.when(F.col("kind") != "parameter", _by_rule())
    rows = rows.withColumn("from_model", said.isNotNull()).withColumn("text", F.coalesce(said, rule)).where("trim(text) <> ''")
    parts = t.condition("text", "subject")
    compares = F.col("kind").isin("single", "conditional")
    part = lambda name, other=none: F.when(compares, parts[name]).otherwise(other).alias(name)
    switch = lambda c: F.when(F.col("kind") == "switch", c)
    form = lambda name: F.when(one, F.coalesce(F.col("s")[name], F.col("text"))).alias(name)
    return rows.select(
        "method", "site", "kind", "index", "text", form("format1"), form("format2"), form("format3"),
        F.when(one, F.coalesce("s.branch", F.lit(True))).when(F.col("kind") == "conditional", F.col("branch")).alias("branch"),
        part("variable", switch(t.switch_variable("text"))), part("operator", switch(F.lit("=="))), part("value", switch(F.when(F.coalesce("is_default", F.lit(False)), F.lit("default")).otherwise(F.col("case_value")))),
        "from_model",
    )
