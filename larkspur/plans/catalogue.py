"""All queries of the engine's own operators."""

from larkspur.plans import cluster_queries, collection_queries, derived_queries, graph_queries, search_queries, stream_queries  # noqa: F401
from larkspur.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
