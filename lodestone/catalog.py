"""All named queries of the library and their SQL."""

from __future__ import annotations

from .plans import cases, consult, curation, events, failures, relational, retrieval, rules, samples, streams, text  # noqa: F401  (registers)
from .plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
