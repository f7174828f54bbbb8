"""Every registered query and its oracle."""

from __future__ import annotations

from . import (  # noqa: F401
    ingest_queries,
    layout_queries,
    library_queries,
    maintenance_queries,
    speech_queries,
    stats_queries,
    text_queries,
)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
