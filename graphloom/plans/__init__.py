"""Registered queries: importing this package fills the registry."""

from . import change, context, graph, io, lookup, review
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "change", "context", "graph", "io", "lookup", "review"]
