"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import basic, modelling, polygons

MODULES = (basic, polygons, modelling)
QUERIES: dict = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL: dict = {name: s for m in MODULES for name, s in m.SQL.items()}
FLAGSHIP = QUERIES["flagship_forecast"]
