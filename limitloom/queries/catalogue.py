"""Importing this module registers every query."""

from limitloom.queries import attach, campaigns, eligibility, expressions, grouping, rules, studies, timelines, vintage  # noqa: F401
from limitloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
