"""Imports every module that registers queries."""

from tablescope.plans import catalog, keys, lineage, profiles, quality, stores  # noqa: F401
from tablescope.plans.registry import ORACLES, QUERIES  # noqa: F401
