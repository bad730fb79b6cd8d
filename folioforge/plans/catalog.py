"""All registered queries: importing this module registers them."""

from . import document_queries, evaluation_queries, quality_queries, retrieval_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
