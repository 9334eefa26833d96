"""Importing this module registers every query of the geometry engine."""

from geoskein.plans import geometry, graphs, sets, skeletons  # noqa: F401
from geoskein.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
