"""Registered queries over the driver tables, each with the SQL that must give the same rows."""

from pixelloom.catalog import (  # noqa: F401
    q_chips,
    q_ingest,
    q_labels,
    q_metrics,
    q_plans,
    q_raster,
    q_runs,
    q_splits,
    q_streams,
    q_zones,
)
from pixelloom.catalog.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
