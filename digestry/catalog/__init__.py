"""Registered queries with their SQL equivalents."""

from digestry.catalog import (  # noqa: F401
    boundaries, corpus, documents, feeds, files, reports, scoring, subwords,
)
from digestry.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
