"""Named queries over the test tables, each with the SQL it has to agree with."""

from gleanframe.registry.base import ORACLES, QUERIES
from gleanframe.registry import (  # noqa: F401  (each module registers its queries)
    catalog_queries, clean_queries, model_queries, nearest_queries, profile_queries, relate_queries,
    report_queries, source_queries, trend_queries, view_queries,
)

__all__ = ["ORACLES", "QUERIES"]
