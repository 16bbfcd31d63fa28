"""Queries over given tables, and the SQL that they must equal."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    from . import daily, files, monthly, places  # noqa: F401
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
