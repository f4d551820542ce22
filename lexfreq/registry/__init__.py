"""All registered queries."""

from lexfreq.registry import labels, loads, texts, words  # noqa: F401
from lexfreq.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
