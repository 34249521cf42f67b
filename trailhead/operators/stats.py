"""Aggregates over call graphs, paths, catalogs and evaluation records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.functions import text as t


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, callers, callees) from one pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    found = ends.groupBy("e.node").agg(F.sum("e.i").alias("callers"), F.sum("e.o").alias("callees"))
    if nodes is None:
        return found
    return nodes.join(found, "node", "left").fillna(0, ["callers", "callees"])


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, callees): sorted list of distinct callees."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("callees"))


def touching(edges: DataFrame, packages: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges of which either end contains one of the package strings."""
    list_ = F.array(*map(F.lit, packages))
    return edges.where(F.exists(list_, lambda p: F.contains(F.col(src), p) | F.contains(F.col(dst), p)))


def by_category(found: DataFrame, categories: DataFrame, key: str = "category", item: str = "sig") -> DataFrame:
    """Count and sorted list of items for every category, also those with none."""
    agg = found.groupBy(key).agg(F.count(item).alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    return categories.join(agg, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def prioritised(found: DataFrame, severity: str = "severity", item: str = "sig") -> DataFrame:
    """Known severities only, worst first, then by name."""
    return found.withColumn("rank", t.severity_rank(severity)).where("rank IS NOT NULL").orderBy("rank", item)


def top_called(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k most called methods."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers")).orderBy(F.desc("callers"), "node").limit(k)


def path_statistics(paths: DataFrame, by: str | None = None) -> DataFrame:
    """Totals, validity and averages of paths (methods, constraints, valid)."""
    grouped = paths.groupBy(by) if by else paths.groupBy()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return grouped.agg(
        F.count("*").alias("total"), F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"),
        zero(F.avg(F.size("methods"))).alias("avg_methods"), zero(F.avg(F.size("constraints"))).alias("avg_constraints"),
        F.coalesce(F.max(F.size("methods")), F.lit(0)).alias("longest"), F.coalesce(F.min(F.size("methods")), F.lit(0)).alias("shortest"),
    )


def complexity(paths: DataFrame, target: str) -> DataFrame:
    """One row: mean and most paths for a target, mean constraints for a path; 0.0 without paths."""
    per = paths.groupBy(target).agg(F.count("*").alias("k"), F.sum(F.size("constraints")).alias("c"))
    return per.agg(
        F.coalesce(F.avg("k"), F.lit(0.0)).alias("avg_paths"), F.coalesce(F.max("k"), F.lit(0)).alias("max_paths"),
        F.coalesce(F.sum("c") / F.sum("k"), F.lit(0.0)).alias("avg_constraints"),
    )


def performance(runs: DataFrame, sums: list[str], highest: list[str]) -> DataFrame:
    """Sums of measures and maxima of others; negative values count as unset."""
    value = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return runs.agg(*(F.coalesce(F.sum(value(c)), F.lit(-1)).alias(c) for c in sums), *(F.coalesce(F.max(value(c)), F.lit(-1)).alias(c) for c in highest))


def evaluation(records: DataFrame, keys: list[str], score: str, success: str) -> DataFrame:
    """Success rate and mean score of each key alone and of their combination, in one pass by grouping sets."""
    names = ", ".join(keys)
    sets = ", ".join(f"({k})" for k in keys) + f", ({names})"
    sql = f"SELECT {names}, COUNT(*) AS n, AVG(CASE WHEN {success} THEN 1.0D ELSE 0.0D END) AS success_rate, COALESCE(AVG(CASE WHEN {success} THEN {score} END), 0.0D) AS mean_score FROM {{records}} GROUP BY GROUPING SETS ({sets})"
    return records.sparkSession.sql(sql, records=records)
