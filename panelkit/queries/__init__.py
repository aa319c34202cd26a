"""Registered queries and their SQL counterparts."""

from . import describing, imputing, modelling, shaping  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
