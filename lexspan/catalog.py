"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from .plans import coding, names, outlines, pages, records, runs, texts

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _plan in (coding, texts, records, names, outlines, runs, pages):
    QUERIES |= _plan.QUERIES
    ORACLE_SQL |= _plan.ORACLE_SQL
