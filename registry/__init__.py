"""Registered queries over the given tables, each beside its SQL twin."""

from registry import q_grid, q_layers, q_overlay, q_series, q_sources, q_tests  # noqa: F401
from registry.views import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
