"""Queries over the given tables; importing the package registers them all."""

from panelkit.queries import (  # noqa: F401
    compare, kept, live, metrics, replies, runs, select, storage, text)
from panelkit.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
