"""Domain tables and registered queries."""

from . import code, reads
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "code", "reads"]
