"""Queries over the test tables and the SQL that checks them."""

from . import basic, learned, manifests, routes, scores, texts, tuning  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
