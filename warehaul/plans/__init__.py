"""Registered queries over the driver's tables."""

from warehaul.plans import comparison, estate, loading, relational, scalars  # noqa: F401
from warehaul.registry import ORACLES, QUERIES  # noqa: F401
