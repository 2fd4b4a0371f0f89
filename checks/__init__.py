"""Registered queries with an independent SQL form of each."""

from . import groups, landing, movies, texts  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
