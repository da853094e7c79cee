"""Named queries."""

from . import duplicates, findings, fixtures, lexical, relations  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
