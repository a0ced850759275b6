"""Registered queries over the telemetry views and the SQL that gives the same rows."""

from roadtrace.queries import journeys, sessions, windows  # noqa: F401
from roadtrace.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
