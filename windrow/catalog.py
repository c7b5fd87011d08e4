"""Queries over the driver's tables and the equal SQL."""

from __future__ import annotations

from windrow.plans.oracles import ORACLES
from windrow.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
