"""Loads every module that registers queries."""

from __future__ import annotations

from finsieve.plans import (  # noqa: F401
    alerts,
    graph,
    kyc,
    models,
    monitoring,
    streams,
    transactions,
)
from finsieve.plans.registry import QUERIES

__all__ = ["QUERIES"]
