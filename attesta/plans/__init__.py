"""Registered queries: operators applied to views of the test tables, and the SQL that checks them."""

from __future__ import annotations

from . import generation, linkage, selection, simulation

QUERIES = selection.QUERIES | linkage.QUERIES | generation.QUERIES | simulation.QUERIES
ORACLE_SQL = selection.ORACLE_SQL | linkage.ORACLE_SQL | generation.ORACLE_SQL | simulation.ORACLE_SQL
