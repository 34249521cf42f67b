"""Program graphs derived from the test tables, as DataFrames and as the same SQL.

Column expressions are text that Spark SQL and the oracle's SQL both accept, so the two
start from equal relations and only the operators under test differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METHOD = {
    "method_id": "p_partkey",
    "class": "'com.' || lower(replace(p_brand, '#', '')) || '.' || p_type",
    "name": "CASE p_partkey % 11 WHEN 0 THEN 'onCreate' WHEN 1 THEN 'onClick' WHEN 2 THEN 'onStartCommand' WHEN 3 THEN 'onReceive' WHEN 4 THEN 'run' "
    "WHEN 5 THEN 'doInBackground' WHEN 6 THEN 'onOptionsItemSelected' WHEN 7 THEN 'query' ELSE replace(p_name, ' ', '_') END",
    "ret": "CASE p_size % 3 WHEN 0 THEN 'void' WHEN 1 THEN 'int' ELSE 'java.lang.String' END",
    "params": "'int' || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ',java.lang.String' WHEN 2 THEN ',android.os.Bundle' ELSE ',long,boolean' END",
    "category": "lower(p_type)",
    "severity": "CASE p_type WHEN 'STANDARD' THEN 'CRITICAL' WHEN 'PROMO' THEN 'HIGH' WHEN 'SMALL' THEN 'HIGH' WHEN 'LARGE' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END",
    "dangerous": "p_size >= 49",
    "size": "p_size",
}
SIG = "'<' || class || ': ' || ret || ' ' || name || '(' || params || ')#' || CAST(method_id AS VARCHAR(20)) || '>'"
STMT = {
    "stmt_id": "event_id",
    "method": "user_id",
    "kind": "CASE event_type WHEN 'signup' THEN 'ENTRY' WHEN 'view' THEN 'ALLOCATION' WHEN 'purchase' THEN 'METHOD_CALL' WHEN 'click' THEN 'IF_CONDITION' ELSE 'SWITCH' END",
    "callee": "CAST(substring(props, 7, length(props) - 7) AS INT)",
    "value": "value",
}

_EDGE_RULE = "dst IS NOT NULL AND src <> dst"
SQL = {
    "edge_cyc": f"edge_cyc AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) t WHERE {_EDGE_RULE})",
    "edge": "edge AS (SELECT src, dst FROM edge_cyc WHERE dst < src)",
    "method": "method AS (SELECT *, " + SIG + " AS sig FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in METHOD.items()) + " FROM part) t)",
    "stmt": "stmt AS (SELECT *, CAST(row_number() OVER (PARTITION BY method ORDER BY ts, stmt_id) AS INT) AS ordinal FROM (SELECT ts, " + ", ".join(f"{v} AS {k}" for k, v in STMT.items()) + " FROM events) t)",
    "sinks": "sinks AS (SELECT method_id AS node FROM method WHERE dangerous)",
}
_NEEDS = {"edge": ["edge_cyc"], "sinks": ["method"]}


def with_sql(*names: str, recursive: bool = False) -> str:
    """A WITH clause of the named relations and what they need."""
    order: list[str] = []

    def add(name):
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[n] for n in order) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges_cyc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): calls between methods, with cycles."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return pairs.where(_EDGE_RULE).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) without cycles."""
    return edges_cyc(spark, sf_dir).where("dst < src")


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*(f"{v} AS {k}" for k, v in METHOD.items())).selectExpr("*", f"{SIG} AS sig")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "events").selectExpr("ts", *(f"{v} AS {k}" for k, v in STMT.items()))
    return made.withColumn("ordinal", F.row_number().over(Window.partitionBy("method").orderBy("ts", "stmt_id")))


def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methods(spark, sf_dir).where("dangerous").select(F.col("method_id").alias("node"))
