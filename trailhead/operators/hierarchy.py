"""Class hierarchies (sub, sup): closures, component types, casts, virtual dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhead.operators import recursion
from trailhead.storage import checkpointed


def supertypes(edges: DataFrame) -> DataFrame:
    """(sub, sup, depth) for every class above another."""
    found = recursion.closure(edges.select(F.col("sub").alias("src"), F.col("sup").alias("dst")))
    return found.select(F.col("src").alias("sub"), F.col("dst").alias("sup"), "depth")


def reflexive(edges: DataFrame) -> DataFrame:
    """(sub, sup), a class being below itself."""
    own = edges.select(F.explode(F.array("sub", "sup")).alias("sub")).distinct()
    return supertypes(edges).select("sub", "sup").unionByName(own.withColumn("sup", F.col("sub")))


def components(edges: DataFrame, kinds: DataFrame, otherwise: str = "Other") -> DataFrame:
    """(class, component): of the nearest superclass in kinds (sup, component, prio)."""
    above = supertypes(edges).join(kinds, "sup")
    nearest = above.groupBy("sub").agg(F.min_by("component", F.struct("depth", "prio")).alias("component"))
    return edges.select("sub").distinct().join(nearest, "sub", "left").select(F.col("sub").alias("class"), F.coalesce("component", F.lit(otherwise)).alias("component"))


def cast_possible(casts: DataFrame, edges: DataFrame) -> DataFrame:
    """possible for casts (value_type, cast_type): one type is the other or below it."""
    below = reflexive(edges)
    pairs = below.unionByName(below.select(F.col("sup").alias("sub"), F.col("sub").alias("sup"))).distinct()
    pairs = pairs.select(F.col("sub").alias("value_type"), F.col("sup").alias("cast_type"), F.lit(True).alias("found"))
    return casts.join(pairs, ["value_type", "cast_type"], "left").select("value_type", "cast_type", F.coalesce("found", F.lit(False)).alias("possible"))


#: Tasks over which rows of one key are dealt where each meets as many others as the output has rows.
DEALT = 16


def dealt_join(many: DataFrame, others: DataFrame, on: list[str], by: Column) -> DataFrame:
    """many joined with others, which are few beside the pairs that the join makes: rows of a key are dealt over tasks by a column."""
    dealt = others.withColumn("_dealt", F.explode(F.array(*map(F.lit, range(DEALT)))))
    return many.withColumn("_dealt", F.pmod(F.xxhash64(by), F.lit(DEALT)).cast("int")).join(dealt, [*on, "_dealt"]).drop("_dealt")


def dispatch(calls: DataFrame, methods: DataFrame, edges: DataFrame, outside: bool = False) -> DataFrame:
    """Targets of virtual calls (call, class, sub_sig): each class at or below the declared one that has the method,
    or else the nearest superclass of that class that has it; with outside, also of classes without a place in the hierarchy.

    Targets are found once for each class and method, not for each call, and made distinct before
    calls are joined; only calls with several classes have theirs made distinct once more.
    """
    calls = calls.select("call", "class", "sub_sig").where("class IS NOT NULL").distinct()
    wanted = calls.select("class", "sub_sig").distinct()
    below = reflexive(edges).select(F.col("sup").alias("class"), F.col("sub").alias("actual"))
    actual = wanted.join(below, "class")
    above = supertypes(edges).select(F.col("sub").alias("actual"), F.col("sup").alias("owner"), "depth")
    own = actual.select("actual").distinct().select("actual", F.col("actual").alias("owner"), F.lit(0).alias("depth"))
    has = methods.select("class", "sub_sig").distinct()
    owners = own.unionByName(above).join(has.withColumnRenamed("class", "owner"), "owner")
    nearest = F.min(F.struct("depth", "owner"))["owner"]
    target = owners.groupBy("actual", "sub_sig").agg(nearest.alias("target"))
    found = actual.join(target, ["actual", "sub_sig"]).select("class", "sub_sig", "target")
    if outside:
        found = found.unionByName(wanted.join(has, ["class", "sub_sig"]).withColumn("target", F.col("class")))
    found = checkpointed(found.distinct())
    classes = calls.groupBy("call", "sub_sig").agg(F.collect_list("class").alias("classes"))
    given = lambda where: dealt_join(classes.where(where).select("call", "sub_sig", F.explode("classes").alias("class")), found, ["class", "sub_sig"], F.col("call")).select("call", "sub_sig", "target")
    return given("size(classes) = 1").unionByName(given("size(classes) > 1").distinct())


def overridden(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """(class, sub_sig, base): methods (class, sub_sig) that a superclass base has too."""
    base = methods.select(F.col("class").alias("sup"), "sub_sig")
    found = methods.select(F.col("class").alias("sub"), "sub_sig").join(supertypes(edges), "sub").join(base, ["sup", "sub_sig"])
    return found.select(F.col("sub").alias("class"), "sub_sig", F.col("sup").alias("base")).distinct()


def more_precise(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """precise for pairs (a, b) of types: the lower one, null where neither is below the other."""
    below = reflexive(edges)
    up = below.select(F.col("sub").alias("a"), F.col("sup").alias("b"), F.lit(True).alias("a_below"))
    down = below.select(F.col("sup").alias("a"), F.col("sub").alias("b"), F.lit(True).alias("b_below"))
    found = pairs.join(up, ["a", "b"], "left").join(down, ["a", "b"], "left")
    return found.select("a", "b", F.when(F.col("a_below"), F.col("a")).when(F.col("b_below"), F.col("b")).alias("precise"))


def can_have_aliases(form, kind, sub_fields, overwritten) -> Column:
    """Whether a newly tainted value can have aliases.

    form is local, array_ref, field, static, constant or other; kind is primitive, string, array
    or object; sub_fields says that the fact taints all fields; overwritten that a local's whole
    value is replaced.
    """
    f, k = (F.col(c) if isinstance(c, str) else c for c in (form, kind))
    whole, sub = (F.col(c) if isinstance(c, str) else c for c in (overwritten, sub_fields))
    heap = f.isin("array_ref", "field", "static")
    return F.when(whole, False).when(heap, True).when((f == "constant") | k.isin("primitive", "string"), False).otherwise(((f == "local") & (k == "array")) | sub)


def can_have_aliases_right(form, kind) -> Column:
    """The same for the right side of a definition, where any local that is no primitive or string may have some."""
    f, k = (F.col(c) if isinstance(c, str) else c for c in (form, kind))
    return F.when(f.isin("array_ref", "field", "static"), True).when((f == "constant") | k.isin("primitive", "string"), False).otherwise(f == "local")
