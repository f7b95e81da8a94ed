"""Registered queries: the operators run on the given tables."""

from vintara.plans import panel_queries, evaluation_queries, calibration_queries, revision_queries, longrun_queries, scenario_queries, draw_queries, source_queries  # noqa: F401, I001
from vintara.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
