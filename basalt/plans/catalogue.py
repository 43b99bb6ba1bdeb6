"""Every registered query with the SQL that an independent engine runs for comparison."""

from __future__ import annotations

from . import dialects, graph, knowledge, relational, semantics
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "dialects", "graph", "knowledge", "relational", "semantics"]
