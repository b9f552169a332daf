"""The registered queries over the reference's operators, with their SQL."""

from __future__ import annotations

from .plans.oracle import SQL
from .plans.queries import QUERIES

FLAGSHIP = "rank_passages"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
