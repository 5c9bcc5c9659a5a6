"""Loads every module that registers queries."""

from . import q_build, q_exact, q_files, q_learn, q_quality, q_rows, q_streaming, q_tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
