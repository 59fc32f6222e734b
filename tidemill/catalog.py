"""Every registered query that needs no subpackage of its own, with its SQL."""

from __future__ import annotations

from tidemill import file_queries, record_queries, time_queries, update_queries
from tidemill.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "file_queries", "record_queries", "time_queries", "update_queries"]
