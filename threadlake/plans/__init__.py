"""Registered queries: each operator over the given tables, with the SQL of its result."""

from . import (
    catalog_queries,
    evaluation_queries,
    event_queries,
    folder_queries,
    function_queries,
    media_queries,
    path_queries,
    search_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
