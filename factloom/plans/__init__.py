"""Registered queries and their SQL twins, by name."""

from . import documents, parsing, reconcile, serving  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
