"""Registered queries and their SQL."""

from . import bars, hot, indicators, more, portfolio, streams, surface
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "bars", "hot", "indicators", "more", "portfolio", "streams", "surface"]
