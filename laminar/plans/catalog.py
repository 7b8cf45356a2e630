"""All queries of the engine; importing this module registers them."""

from laminar.plans import corpus_queries, cut_queries, graph_queries, mesh_queries, stream_queries, study_queries  # noqa: F401
from laminar.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
