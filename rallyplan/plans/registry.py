"""All queries of the engine and their oracle SQL."""

from __future__ import annotations

from rallyplan.plans import clock_queries, detail_queries, geometry_queries, insight_queries, movement_queries, picture_queries, profile_stage, rally_queries, sequence_queries, sound_queries, stage_queries, swing_queries, table_queries, time_queries  # noqa: F401
from rallyplan.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
