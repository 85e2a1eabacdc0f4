"""Registered queries: each applies operators of this library to the standard tables, with equivalent SQL."""

from . import catalog, codecs, datasets, depth, filters, imaging, layouts, metrics, motion, raster, reports, sampling, small, sources, stats, streams, tiling, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
