"""All registered queries and their SQL oracles, gathered from the plan modules."""

from __future__ import annotations

from . import (analysis_queries, catalog_queries, dashboard_queries, more_queries, profile_queries, recommend_queries,  # noqa: F401
               source_queries)
from .catalog_queries import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
