"""Every registered query with its DuckDB equivalent."""

from __future__ import annotations

from verdigris.plans import coverage, ledger, replay, scores, storage  # noqa: F401
from verdigris.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
