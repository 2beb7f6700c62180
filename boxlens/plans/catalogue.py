"""Importing this module registers every query."""

from . import boxes_queries, raster_queries, report_queries, source_queries, stats_queries, trace_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
