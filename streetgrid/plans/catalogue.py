"""All queries of the library; importing the modules registers them."""

from . import alignment, assembly, evaluation, linear, modelling, reports, runs, spatial, tabular, vectors  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
