"""Library models as tables: resolution through the hierarchy, application, algebra, compaction.

A flow is (class, method, from, to, is_alias) with endpoints struct(kind, param, fields, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailhead.functions import containers
from trailhead.operators import hierarchy
from trailhead.storage import checkpointed


def resolved(calls: DataFrame, flows: DataFrame, edges: DataFrame) -> DataFrame:
    """Flows for calls (call, class, method): of the class itself, else of its nearest superclass
    or interface, else of all classes below it together."""
    known = flows.select("class", "method").distinct()
    own = calls.select("call", "class", "method", F.col("class").alias("owner"), F.lit(0).alias("depth"))
    # of a class's place only owners with flows matter, which are few beside all classes below it
    up = hierarchy.supertypes(edges)
    owners = known.select("class").distinct()
    down = up.join(owners.withColumnRenamed("class", "sub"), "sub", "left_semi")
    up = up.join(owners.withColumnRenamed("class", "sup"), "sup", "left_semi")
    above = calls.join(up.select(F.col("sub").alias("class"), F.col("sup").alias("owner"), "depth"), "class").select("call", "class", "method", "owner", "depth")
    below = calls.join(down.select(F.col("sup").alias("class"), F.col("sub").alias("owner")), "class").select("call", "class", "method", "owner", F.lit(1 << 20).alias("depth"))
    found = own.unionByName(above).unionByName(below).join(known.withColumnRenamed("class", "owner"), ["owner", "method"])
    nearest = F.min("depth").over(Window.partitionBy("call"))
    found = found.withColumn("nearest", nearest).where("depth = nearest")
    first = F.min("owner").over(Window.partitionBy("call"))  # ties of classes above: the first by name; classes below: all
    found = found.withColumn("first", first).where(f"depth = {1 << 20} OR owner = first").select("call", "owner", "method")
    return found.join(flows.withColumnRenamed("class", "owner"), ["owner", "method"])


def missing(calls: DataFrame, flows: DataFrame) -> DataFrame:
    """(class, method, n): called methods that no summary covers, by number of calls."""
    return calls.join(flows.select("class", "method").distinct(), ["class", "method"], "left_anti").groupBy("class", "method").agg(F.count("*").alias("n"))


def _same_place(e: Column, kind: Column, param: Column) -> Column:
    return (e["kind"] == kind) & e["param"].eqNullSafe(param)


def applied(taints: DataFrame, flows: DataFrame, clears: DataFrame | None = None) -> DataFrame:
    """Taints after a call, for taints (call, kind, param, fields) before it and the call's flows.

    A flow applies where its start's fields begin the taint's fields, or the other way round
    if the start takes a taint of the whole object. What is cleared does not stay.
    """
    joined = taints.join(flows, "call").where(_same_place(F.col("from"), F.col("kind"), F.col("param")))
    wider = containers.starts_with(F.col("from.fields"), F.col("fields")) & ~F.coalesce(F.col("from.match_strict"), F.lit(False))
    rest = F.when(containers.starts_with(F.col("fields"), F.col("from.fields")), containers.rebased(F.col("fields"), F.col("from.fields"), F.col("to.fields"))).when(wider, F.col("to.fields"))
    made = joined.withColumn("rest", rest).where("rest IS NOT NULL").select("call", F.col("to.kind").alias("kind"), F.col("to.param").alias("param"), containers.append(F.col("rest"), F.array().cast("array<string>"))["fields"].alias("fields"))
    stay = taints.select("call", "kind", "param", "fields").distinct()
    if clears is not None:
        gone = taints.join(clears, "call").where(_same_place(F.col("clear"), F.col("kind"), F.col("param")) & containers.starts_with(F.col("fields"), F.col("clear.fields")))
        stay = stay.exceptAll(gone.select("call", "kind", "param", "fields").distinct())
    return stay.unionByName(made).distinct()


def inverse(flows: DataFrame) -> DataFrame:
    return flows.select(*[c for c in flows.columns if c not in ("from", "to")], F.col("to").alias("from"), F.col("from").alias("to"))


def aliases(flows: DataFrame) -> DataFrame:
    """Alias flows hold both ways."""
    found = flows.where("is_alias")
    return found.unionByName(inverse(found).select(*found.columns)).distinct()


def _coarser(a: Column, b: Column) -> Column:
    """a says at least what b says: the same places, with shorter fields."""
    part = lambda e: _same_place(a[e], b[e]["kind"], b[e]["param"]) & containers.starts_with(b[e]["fields"], a[e]["fields"])
    return part("from") & part("to")


def compacted(flows: DataFrame) -> DataFrame:
    """Flows of each method without duplicates, without those coarser than another one, and of two
    mutually reverse alias flows the one whose target comes first.

    A method has few flows, so they are compared inside one array of it.
    """
    flow = F.struct("from", "to", "is_alias")
    rows = flows.groupBy("class", "method").agg(F.array_sort(F.collect_set(flow)).alias("all"))
    other = lambda x, y: ~(x == y)
    precise = F.filter("all", lambda x: ~F.exists("all", lambda y: other(x, y) & _coarser(x, y) & ~_coarser(y, x) & (x["is_alias"] == y["is_alias"])))
    rows = rows.withColumn("precise", precise)
    reverse = lambda x, y: (x["from"] == y["to"]) & (x["to"] == y["from"])
    kept = F.filter("precise", lambda x: ~(x["is_alias"] & F.exists("precise", lambda y: y["is_alias"] & other(x, y) & reverse(x, y) & (y["to"] < x["to"]))))
    return rows.select("class", "method", F.explode(kept).alias("f")).select("class", "method", "f.from", "f.to", "f.is_alias")


def dependencies(flows: DataFrame) -> DataFrame:
    """(class, needs): classes that summaries name as base types but have no summary themselves."""
    named = flows.select("class", F.explode(F.array("from.base_type", "to.base_type")).alias("needs")).where("needs IS NOT NULL").distinct()
    return named.join(flows.select(F.col("class").alias("needs")).distinct(), "needs", "left_anti").select("class", "needs")


def processing_order(uses: DataFrame) -> DataFrame:
    """(class, n): classes by the number of others that they need (class, needs), so that the most independent are summarised first."""
    return uses.groupBy("class").agg(F.count_distinct("needs").alias("n")).orderBy("n", "class")


def listed(calls: DataFrame, rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(call, action) by a wrapper list: rules (kind, class, method); the nearest class that says anything decides;
    at equal distance exclusion comes before killing before propagation."""
    up = hierarchy.supertypes(edges).select(F.col("sub").alias("class"), F.col("sup").alias("owner"), "depth")
    own = calls.select("class").distinct().select("class", F.col("class").alias("owner"), F.lit(0).alias("depth"))
    order = F.when(F.col("kind") == "exclude", 0).when(F.col("kind") == "kill", 1).otherwise(2)
    found = calls.join(own.unionByName(up), "class").join(rules.withColumnRenamed("class", "owner"), ["owner", "method"])
    return found.groupBy("call").agg(F.min_by("kind", F.struct("depth", order)).alias("action"))


def through_gaps(flows: DataFrame, bodies: DataFrame) -> DataFrame:
    """(method, src, dst): flows from a method's start to its end, through the user code that fills its gaps.

    flows: (method, src, src_gap, dst, dst_gap), a gap being a call that a library method makes to
    code of its user; bodies: (gap, src, dst) are the flows of that code. A fact that enters a gap
    goes on at its exit once the body passes it.
    """
    rows = checkpointed(flows.select("method", "src", F.coalesce("src_gap", F.lit("")).alias("src_gap"), "dst", F.coalesce("dst_gap", F.lit("")).alias("dst_gap")).distinct())
    onward = rows.where("src_gap <> ''").select("method", F.col("src_gap").alias("gap"), F.col("src").alias("place"), F.col("dst").alias("next"), "dst_gap")
    inside = checkpointed(bodies.select("gap", F.col("src").alias("dst"), F.col("dst").alias("place")).distinct())
    seen = frontier = checkpointed(rows.where("src_gap = ''").select("method", "src", "dst", F.col("dst_gap").alias("gap")).distinct())
    while True:
        back = frontier.where("gap <> ''").join(inside, ["gap", "dst"]).select("method", "src", "gap", "place")
        step = back.join(onward, ["method", "gap", "place"]).select("method", "src", F.col("next").alias("dst"), F.col("dst_gap").alias("gap")).distinct()
        frontier = checkpointed(step.join(seen, ["method", "src", "dst", "gap"], "left_anti"))
        if frontier.isEmpty():
            return seen.where("gap = ''").select("method", "src", "dst")
        seen = seen.unionByName(frontier)


def identity(calls: DataFrame, taints: DataFrame) -> DataFrame:
    """(call, value) after library calls (call, base, args, result): what was tainted stays, and the result is if the base or an argument was."""
    touched = taints.join(calls, "call").where("result IS NOT NULL AND (base <=> value OR array_contains(args, value))")
    return taints.select("call", "value").unionByName(touched.select("call", F.col("result").alias("value"))).distinct()


#: Ways to model library calls, and the tables that each asks, the first that knows a call deciding.
WRAPPERS = {"none": (), "default": ("summaries",), "stubdroid": ("summaries",), "defaultfallback": ("summaries", "list"), "easy": ("list",)}


def modelled(mode: str, calls: DataFrame, **effects: DataFrame) -> DataFrame:
    """Effects (call, source, target) of calls (call) by a mode of WRAPPERS; effects are tables by name: summaries, list.

    Mode multi takes all tables, each for all calls.
    """
    if mode != "multi" and mode not in WRAPPERS:
        raise ValueError(f"unknown mode {mode}")
    names = tuple(effects) if mode == "multi" else WRAPPERS[mode]
    found, open_calls = calls.sparkSession.createDataFrame([], effects[next(iter(effects))].select("call", "source", "target").schema), calls.select("call").distinct()
    for name in names:
        found = found.unionByName(effects[name].select("call", "source", "target").join(open_calls, "call", "left_semi"))
        if mode != "multi":
            open_calls = open_calls.join(effects[name].select("call").distinct(), "call", "left_anti")
    return found.distinct()


# Native methods, and from where to where each passes a taint.
NATIVE = (("arraycopy", "arg0", "arg2"), ("newArray", "arg1", "return"), ("compareAndSwapObject", "arg3", "arg0"))


def native(calls: DataFrame, taints: DataFrame) -> DataFrame:
    """(call, place): places that a native call (call, name) taints, for active taints (call, place, active)."""
    rules = calls.sparkSession.createDataFrame(NATIVE, "name string, place string, target string")
    return taints.where("active").join(calls.select("call", "name"), "call").join(rules, ["name", "place"]).select("call", F.col("target").alias("place")).distinct()
