"""All queries by name, and the SQL that says the same."""

from __future__ import annotations

from keelgrid.plans import chain, shapes, vessel

QUERIES = vessel.QUERIES | shapes.QUERIES | chain.QUERIES
ORACLES = vessel.ORACLES | shapes.ORACLES | chain.ORACLES
