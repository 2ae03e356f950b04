"""Importing this module registers every query."""

from __future__ import annotations

from cashlens.plans import assembly, documents, events, feeds, history, ledger, records, rotation, screening, triggers, valuation, watchlist  # noqa: F401
from cashlens.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
