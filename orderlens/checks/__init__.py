"""Checked queries over the given tables."""

from . import (history_queries, job_queries, recommend_queries, text_queries,  # noqa: F401
               variant_queries, vector_queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
