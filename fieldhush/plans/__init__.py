"""Registered queries over the supplied tables."""

from fieldhush.plans import q_aggregates, q_evaluate, q_intervals, q_models, q_parse, q_series, q_sources, q_stats  # noqa: F401
from fieldhush.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
