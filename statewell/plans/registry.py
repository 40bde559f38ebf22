"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_chain, queries_core, queries_extra, queries_models, queries_more  # noqa: F401  register
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
