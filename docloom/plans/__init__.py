"""Queries over whole tables: each applies operators and names the SQL that gives the same rows."""

from . import blueprints, chunks, content, jobs, money, streams, text, usage
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "blueprints", "chunks", "content", "jobs", "money", "streams", "text", "usage"]
