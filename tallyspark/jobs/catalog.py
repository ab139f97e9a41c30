"""Every registered query of the library and its SQL."""

from __future__ import annotations

from . import data_queries, definition_queries

QUERIES = {**data_queries.QUERIES, **definition_queries.QUERIES}
ORACLE = {**data_queries.ORACLE, **definition_queries.ORACLE}
