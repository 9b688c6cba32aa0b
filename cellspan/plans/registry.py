"""All registered queries with their SQL. Balls come from `embeddings`, surfaces and hierarchies from the order tables, frames
from `events`."""

from __future__ import annotations

from cellspan.plans import hierarchy, matching, measures, selection, space, statistics, structures

MODULES = (space, hierarchy, measures, selection, statistics, matching, structures)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL: dict = {name: text for m in MODULES for name, text in m.SQL.items()}
