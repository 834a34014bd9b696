"""Whole comparison plans and the registered queries."""

from . import queries_compare, queries_plan, queries_runs, queries_streaming, queries_tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
