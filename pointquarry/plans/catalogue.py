"""All point-cloud queries and the SQL that checks them."""

from __future__ import annotations

from pointquarry.plans import calls, files, maps, measures, profiles, shades, transfers, trees
from pointquarry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "calls", "files", "maps", "measures", "profiles", "shades", "transfers", "trees"]
