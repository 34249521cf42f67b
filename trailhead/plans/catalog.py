"""All queries of the library's own operators."""

from __future__ import annotations

from trailhead.plans import app_queries, code_queries, container_queries, document_queries, extraction_queries, file_queries, flow_queries, front_queries, graph_queries, library_queries, model_queries, provenance_queries, rule_queries, tabulation_queries, taint_queries, value_queries  # noqa: F401  (they register their queries)
from trailhead.plans.registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    return graph_queries.dangerous_reach(spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
