"""Registered queries: QUERIES by name, and SQL with the DuckDB text of those that SQL can express."""

from quarry.plans import audits, calibration, objects, pixel_metrics, resampling, storage, vector_scores
from quarry.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audits", "calibration", "objects", "pixel_metrics", "resampling", "storage", "vector_scores"]
