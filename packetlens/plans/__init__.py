"""Named queries; importing this package registers them."""

from . import alert_queries, cache_queries, edit_queries, event_queries, ratio_queries, results_queries, stream_queries, technique_queries, text_queries, version_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "alert_queries", "cache_queries", "edit_queries", "event_queries", "ratio_queries", "results_queries", "stream_queries", "technique_queries", "text_queries", "version_queries"]
