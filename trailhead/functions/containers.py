"""Container contexts, three-valued logic and access paths as column expressions.

An interval context is struct(min, max); a key context is an array of strings; null is the
unknown context. Truth values are nullable booleans: null is "maybe".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FIELDS = 5


def interval(low, high) -> Column:
    return F.struct(low.cast("int").alias("min"), high.cast("int").alias("max"))


def intersects(a: Column, b: Column) -> Column:
    """True if both are the same single position, false if they can't meet, else maybe."""
    apart = (a["max"] < b["min"]) | (b["max"] < a["min"])
    same = (a["min"] == a["max"]) & (b["min"] == b["max"]) & (a["min"] == b["min"])
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(apart, False).when(same, True)


def interval_entails(a: Column, b: Column) -> Column:
    """a covers b."""
    return F.coalesce((a["min"] <= b["min"]) & (b["max"] <= a["max"]), F.lit(False))


def shift(a: Column, n: Column, compat: bool = False) -> Column:
    """Both bounds moved; compat repeats the lower bound as the upper one."""
    low = a["min"] + n
    return interval(low, low if compat else a["max"] + n)


def shift_from(a: Column, at: Column, n: Column) -> Column:
    """Positions at or after a place may move by n: the upper bound grows, the lower one too if surely after."""
    return interval(F.when(a["min"] >= at, a["min"] + n).otherwise(a["min"]), F.when(a["max"] >= at, a["max"] + n).otherwise(a["max"]))


def hull(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), interval(F.least(a["min"], b["min"]), F.greatest(a["max"], b["max"])))


def before_or_at(a: Column, b: Column) -> Column:
    """Whether every position of a is at most every one of b; maybe where they overlap."""
    return F.when(a["max"] <= b["min"], True).when(a["min"] > b["max"], False)


def keys_intersect(a: Column, b: Column) -> Column:
    """True for the same single key, false for disjoint sets, else maybe."""
    single = (F.size(a) == 1) & (F.size(b) == 1) & (a[0] == b[0])
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(~F.arrays_overlap(a, b), False).when(single, True)


def keys_entail(a: Column, b: Column) -> Column:
    """a is a subset of b: the opposite direction to intervals, on purpose."""
    return F.coalesce(F.size(F.array_except(a, b)) == 0, F.lit(False))


def both(a: Column, b: Column) -> Column:
    return a & b


def either(a: Column, b: Column) -> Column:
    return a | b


def negated(a: Column) -> Column:
    return ~a


def starts_with(path: Column, prefix: Column) -> Column:
    """Whether an array of fields begins with another."""
    return (F.size(prefix) == 0) | (F.slice(path, 1, F.greatest(F.size(prefix), F.lit(1))) == prefix)


def append(path: Column, more: Column, most: int = MAX_FIELDS) -> Column:
    """Fields appended up to the bound; cut_off tells whether some were left out."""
    whole = F.concat(path, more)
    return F.struct(F.slice(whole, 1, most).alias("fields"), (F.size(whole) > most).alias("cut_off"))


def drop_last(path: Column) -> Column:
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def rebased(path: Column, prefix: Column, onto: Column) -> Column:
    """The path with its prefix replaced; null if it does not begin so."""
    rest = F.when(F.size(path) > F.size(prefix), F.slice(path, F.size(prefix) + 1, F.greatest(F.size(path), F.lit(1)))).otherwise(F.slice(path, 1, 0))
    return F.when(starts_with(path, prefix), F.concat(onto, rest))


def without_loops(path: Column, this: str = "this$0") -> Column:
    """Each run of a field that repeats itself as one field, and the outer-instance field only once in a row."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    return F.aggregate(path, F.array().cast("array<string>"), lambda acc, x: F.when(last(acc).eqNullSafe(x), acc).otherwise(F.concat(acc, F.array(x))))


def path_entails(a_base: Column, a: Column, a_sub: Column, b_base: Column, b: Column, compat: bool = True) -> Column:
    """Whether access path a covers b: equal base and a's fields, if tainted with sub-fields, begin b's.

    compat keeps the reference behaviour that a path with fields covers one that has none.
    """
    covers = F.when(F.size(a) <= F.size(b), starts_with(b, a) & (a_sub | (F.size(a) == F.size(b)))).otherwise(F.lit(compat) & (F.size(b) == 0))
    return (a_base == b_base) & covers


def more_dims(type_name: Column, n: int = 1) -> Column:
    return F.concat(type_name, F.lit("[]" * n))


def element_type(type_name: Column) -> Column:
    return F.regexp_replace(type_name, r"\[\]$", "")
