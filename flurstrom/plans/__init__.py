"""Registered queries."""

from . import addresses, files, history, places, served  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
