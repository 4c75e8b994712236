"""All queries over the test tables."""

from __future__ import annotations

from granary.plans import evaluation, retrieval, serving, storage, texts  # noqa: F401
from granary.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
