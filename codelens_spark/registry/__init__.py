"""All registered queries with their check SQL."""

from __future__ import annotations

from .core import ORACLES, QUERIES
from . import aggregates, graphs, joins, predicates, sources, streams, texts, windows  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
