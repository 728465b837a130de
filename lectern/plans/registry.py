"""All queries over the tables, by name, and the SQL that checks them."""

from __future__ import annotations

from . import catalog, texts, vectors  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
