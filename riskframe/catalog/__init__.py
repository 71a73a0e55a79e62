"""Every registered query with its oracle."""

from riskframe.catalog import (  # noqa: F401
    data_queries,
    feature_queries,
    learning_queries,
    metric_queries,
    monitor_queries,
    profile_queries,
    stream_queries,
)
from riskframe.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
