"""One query an operator, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from ..registry import ORACLES, QUERIES
from . import folds, joins, metrics, ordered, others, packing, selection, streams, texts  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
