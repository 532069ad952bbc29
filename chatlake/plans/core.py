"""All core queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from chatlake.plans import general, reference

QUERIES: dict = reference.QUERIES | general.QUERIES
SQL: dict[str, str] = reference.SQL | general.SQL
