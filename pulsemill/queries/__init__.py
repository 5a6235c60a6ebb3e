"""The registered queries of the library and their SQL."""

from __future__ import annotations

from .base import ORACLES, QUERIES  # noqa: I001
from . import cleaning, cohort, landmarks, modelling, physiology, reporting, sequences, series, streams, temporal  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
