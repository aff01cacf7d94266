"""Named queries over the input tables, and the SQL that checks them."""

from . import graph_queries, grid_queries, scalar_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "entry"]


def entry(spark, sf_dir: str):
    """The flagship: profiles of every column of a table seen as a sheet."""
    return QUERIES["column_profiles"](spark, sf_dir)
