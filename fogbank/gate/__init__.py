"""Queries over the driver tables, each beside SQL that computes the same independently."""

from fogbank.gate import cell_queries, model_queries, series_queries  # noqa: F401
from fogbank.gate.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
