"""All registered queries over the driver tables."""

from __future__ import annotations

from penumbra.plans import extras, fits, geometry, networks, outlines, rules, snapping, sweeps, tables, walking  # noqa: F401  they register their queries
from penumbra.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
