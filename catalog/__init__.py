"""Registered queries over the test tables, each with SQL to check it where SQL can express it."""

from catalog.base import QUERIES, SQL
from catalog import tables, forecasts, cleaning, features, profiles, scores, awkward, invariants  # noqa: F401

__all__ = ["QUERIES", "SQL"]
