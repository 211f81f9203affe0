"""All registered queries; importing this module imports every family."""

from vectorloom.plans import cooc_queries, evaluate_queries, factor_queries, graph_queries, io_queries, model_queries, more_queries, search_queries, text_queries, vocab_queries, weight_queries  # noqa: F401
from vectorloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
