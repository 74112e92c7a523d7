"""All registered queries of the time-series engine and their SQL twins."""

from __future__ import annotations

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
