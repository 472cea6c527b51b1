"""All panel queries and their SQL."""

from __future__ import annotations

from . import describe, effects, tables

QUERIES = {**effects.QUERIES, **describe.QUERIES, **tables.QUERIES}
ORACLE_SQL = {**effects.ORACLE_SQL, **describe.ORACLE_SQL, **tables.ORACLE_SQL}
