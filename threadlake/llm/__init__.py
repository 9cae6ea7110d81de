"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
