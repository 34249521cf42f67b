"""Extension points: what an analysis may be given, as protocols over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.config import CategoryMode


class DefinitionProvider(Protocol):
    """Source and sink definitions (sig, position, param_index, fields, is_source, is_sink, category)."""

    def definitions(self) -> DataFrame: ...


class SourceSinkManager(Protocol):
    def sources(self, stmts: DataFrame) -> DataFrame: ...

    def sinks(self, stmts: DataFrame) -> DataFrame: ...


class Wrapper(Protocol):
    """Facts (call, kind, param, fields) after a library call, for those before it."""

    def applied(self, taints: DataFrame) -> DataFrame: ...


ResultHandler = Callable[[DataFrame], DataFrame]


class ByDefinition:
    """Matches called methods with definitions by signature, then by sub-signature in a class above."""

    def __init__(self, definitions: DataFrame, above: DataFrame):
        self.given, self.above = definitions, above

    def _matched(self, stmts: DataFrame, role: str) -> DataFrame:
        parts = F.struct(F.regexp_extract("sig", r"^<([^:]+):", 1).alias("class"), F.regexp_extract("sig", r": (.*)>$", 1).alias("sub"))
        known = self.given.where(role).withColumn("p", parts).select(F.col("p.class").alias("owner"), F.col("p.sub").alias("sub"), "category", "position", "param_index")
        calls = stmts.where("callee IS NOT NULL").withColumn("class", F.regexp_extract("callee", r"^<([^:]+):", 1)).withColumn("sub", F.regexp_extract("callee", r": (.*)>$", 1))
        own = calls.withColumn("owner", F.col("class")).withColumn("depth", F.lit(0))
        up = calls.join(self.above.select(F.col("sub").alias("class"), F.col("sup").alias("owner"), "depth"), "class").select(*own.columns)
        found = own.unionByName(up).join(known, ["owner", "sub"])
        return found.groupBy("method", "stmt", "position", "param_index").agg(F.min_by("category", F.struct("depth", "owner")).alias("category"))

    def sources(self, stmts: DataFrame) -> DataFrame:
        return self._matched(stmts, "is_source")

    def sinks(self, stmts: DataFrame) -> DataFrame:
        return self._matched(stmts, "is_sink")


def by_category(definitions: DataFrame, mode: CategoryMode, categories: set[str]) -> DataFrame:
    """All but the excluded categories, or only the included ones; no category counts as one of its own."""
    listed = F.coalesce("category", F.lit("")).isin(*categories)
    return definitions.where(listed if mode == CategoryMode.USE_ONLY_INCLUDED else ~listed)


def recorded(wrapped: DataFrame, calls: DataFrame) -> DataFrame:
    """(callee, hits, misses): calls that a wrapper had flows for, and those it had none for."""
    hit = wrapped.select("call").distinct().withColumn("hit", F.lit(1))
    return calls.join(hit, "call", "left").groupBy("callee").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
