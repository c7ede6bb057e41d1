"""Named queries over the test tables, and the same results in SQL."""

from __future__ import annotations

from . import ingest, names, releases, tools

MODULES = [names, releases, ingest, tools]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
