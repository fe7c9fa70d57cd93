"""The library's queries over the driver's tables."""

from . import collecting, coverage, dashboards, ingest, intake, pages, releases, reporting, selection, views  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
