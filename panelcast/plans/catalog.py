"""All named queries and their SQL twins."""

from panelcast.plans import (  # noqa: F401
    catalog_columns,
    catalog_models,
    catalog_scores,
    catalog_sources,
    catalog_tables,
    catalog_windows,
)
from panelcast.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
