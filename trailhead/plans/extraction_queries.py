"""Constraints in words from the statements of the test tables, by rule and by a client."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhead.operators import extraction
from trailhead.plans import binding as b
from trailhead.plans.registry import query

_SITES = {
    "single": ("IF_CONDITION", "'$i' || CAST(callee % 7 AS VARCHAR(9)) || ' gt ' || CAST(ordinal % 5 AS VARCHAR(9))"),
    "conditional": ("IF_CONDITION", "'$i' || CAST(callee % 7 AS VARCHAR(9)) || ' eq ' || CAST(ordinal % 5 AS VARCHAR(9))"),
    "switch": ("SWITCH", "'lookupswitch($i0)'"),
    "parameter": ("METHOD_CALL", "CASE callee % 3 WHEN 0 THEN '$r1' WHEN 1 THEN 'k' || CAST(callee % 5 AS VARCHAR(9)) ELSE '$z' || CAST(callee % 2 AS VARCHAR(9)) || '.f' END"),
    "variable": ("ALLOCATION", "'$v' || CAST(callee % 4 AS VARCHAR(9))"),
}
_COLUMNS = "CAST(method AS VARCHAR(20)) AS method, CAST(ordinal AS BIGINT) AS site, '{kind}' AS kind, {subject} AS subject, 'call ' || CAST(callee % 10 AS VARCHAR(9)) AS target, ordinal % 2 = 0 AS branch, CAST(callee % 4 AS VARCHAR(9)) AS case_value, callee % 4 = 0 AS is_default, CAST(callee % 2 AS INT) AS index, CASE callee % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'boolean' ELSE 'double' END AS type, callee % 7 AS seven"
_FROM = "SELECT " + _COLUMNS + " FROM {stmt} WHERE kind = '{of}'"
_SQL = b.with_sql("stmt")[:-1] + ", site AS (" + " UNION ALL ".join(_FROM.format(kind=k, subject=s, stmt="stmt", of=of) for k, (of, s) in _SITES.items()) + "), size AS (SELECT CAST(method AS VARCHAR) AS method, COUNT(*) AS n FROM stmt GROUP BY method)"
_RULE = """CASE kind WHEN 'single' THEN '[' || replace(replace(subject, '$', 'var_'), ' gt ', ' > ') || ']' WHEN 'conditional' THEN CASE WHEN branch THEN '[' ELSE '[!(' END || replace(replace(subject, '$', 'var_'), ' eq ', ' == ') || CASE WHEN branch THEN ']' ELSE ')]' END
  WHEN 'switch' THEN '[switch_var == ' || CASE WHEN is_default THEN 'default' ELSE case_value END || ']' WHEN 'parameter' THEN CASE WHEN subject <> '$r1' THEN 'param[' || CAST(index AS VARCHAR) || '] = ' || replace(subject, '$', 'var_') END
  ELSE replace(subject, '$', 'var_') || CASE type WHEN 'int' THEN '_int' WHEN 'boolean' THEN '_bool' ELSE '' END END"""
_PARTS = """CASE WHEN kind IN ('single', 'conditional') THEN regexp_extract(text, '([a-z0-9_]+) (==|>) ([a-z0-9]+)', 1) WHEN kind = 'switch' THEN regexp_extract(text, '([a-z_]+) ==', 1) END AS variable, CASE WHEN kind IN ('single', 'conditional') THEN regexp_extract(text, '([a-z0-9_]+) (==|>) ([a-z0-9]+)', 2) WHEN kind = 'switch' THEN '==' END AS operator,
  CASE WHEN kind IN ('single', 'conditional') THEN regexp_extract(text, '([a-z0-9_]+) (==|>) ([a-z0-9]+)', 3) WHEN kind = 'switch' THEN CASE WHEN is_default THEN 'default' ELSE case_value END END AS value"""


def _sites(spark, sf):
    stmts = b.statements(spark, sf)
    rows = None
    for kind, (of, subject) in _SITES.items():
        made = stmts.where(f"kind = '{of}'").selectExpr(*_split(_COLUMNS.format(kind=kind, subject=subject)))
        rows = made if rows is None else rows.unionByName(made)
    return rows, extraction.bodies(stmts.selectExpr("CAST(method AS STRING) AS method", "'m' || CAST(method AS STRING) AS sig", "array('int') AS params").distinct(), stmts.selectExpr("CAST(method AS STRING) AS method", "ordinal AS at", "kind || ' ' || CAST(callee AS STRING) AS text"))


def _split(columns: str) -> list[str]:
    """The columns of a SELECT, which have no comma but between them."""
    return columns.split(", ")


def _client():
    def ask(prompt: str) -> str:
        body, question = prompt.split("[METHOD_BODY]\n")[1].split("\n[/METHOD_BODY]\n\n")
        n = len(body.split("\n")) - 2
        if "$i3" in question or "'f'" in question or "Argument 1" in question:
            raise ValueError("no answer")
        if "Target: " in question:
            return f"BRANCH_DIRECTION_START false BRANCH_DIRECTION_END BOOLEAN_CONSTRAINT_START lines > {n} BOOLEAN_CONSTRAINT_END TECHNICAL_CONSTRAINT_START reads BRANCH TECHNICAL_CONSTRAINT_END"
        return f"lines == {n}"

    return ask


@query(_SQL + f", said AS (SELECT *, {_RULE} AS text FROM site) SELECT method, site, kind, text, {_PARTS} FROM said WHERE text IS NOT NULL")
def constraints_by_rule(spark, sf):
    """Constraints of all five kinds without a model."""
    return extraction.extracted(*_sites(spark, sf)).select("method", "site", "kind", "text", "variable", "operator", "value")


@query(
    _SQL + f""", said AS (SELECT site.*, n, kind IN ('single', 'conditional') AND seven = 3 OR kind = 'parameter' AND index = 1 AS failed FROM site JOIN size USING (method)),
    told AS (SELECT *, CASE WHEN failed THEN CASE WHEN kind <> 'parameter' THEN {_RULE} END WHEN kind = 'single' THEN 'lines > ' || CAST(n AS VARCHAR) ELSE 'lines == ' || CAST(n AS VARCHAR) END AS text FROM said)
    SELECT method, site, kind, text, CASE WHEN kind = 'single' THEN text END AS format2, CASE WHEN kind = 'single' THEN CASE WHEN failed THEN text ELSE 'reads BRANCH' END END AS format3, CASE kind WHEN 'single' THEN failed WHEN 'conditional' THEN branch END AS branch, NOT failed AS from_model, {_PARTS} FROM told WHERE text IS NOT NULL"""
)
def constraints_by_model(spark, sf):
    """The same by a client that sees whole methods and fails at some questions."""
    return extraction.extracted(*_sites(spark, sf), client=_client, wait=0.0).select("method", "site", "kind", "text", "format2", "format3", "branch", "from_model", "variable", "operator", "value")
