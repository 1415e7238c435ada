"""Every registered query of the raster engine and its SQL oracle."""

from __future__ import annotations

from orbitframe.plans import queries_imagery, queries_windows

QUERIES = queries_imagery.QUERIES | queries_windows.QUERIES
ORACLES = queries_imagery.ORACLES | queries_windows.ORACLES
