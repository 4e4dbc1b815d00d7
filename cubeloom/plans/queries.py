"""All registered queries of the operators over cubes."""

from . import queries_analysis, queries_cube, queries_models  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
