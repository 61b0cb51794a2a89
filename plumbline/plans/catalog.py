"""All registered queries of the engine's own operators, bound to the driver's tables."""

from __future__ import annotations

from . import drawings, grids, names, readings, rollups, series, shapes, states
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "drawings", "grids", "names", "readings", "rollups", "series", "shapes", "states"]
