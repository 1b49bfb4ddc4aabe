"""Queries of the reading-analytics engine and the SQL they are held against."""

from __future__ import annotations

from .operators import clean, geometry, importing, labels, lessons, progress, records, repair, scalar, sections, sessions, text
from .sources import store
from .streaming import reading

QUERIES = {**sessions.QUERIES, **scalar.QUERIES, **text.QUERIES, **records.QUERIES, **labels.QUERIES, **progress.QUERIES, **repair.QUERIES, **clean.QUERIES, **sections.QUERIES, **geometry.QUERIES, **lessons.QUERIES, **importing.QUERIES, **store.QUERIES, **reading.QUERIES}
ORACLE_SQL = {**sessions.ORACLE_SQL, **scalar.ORACLE_SQL, **text.ORACLE_SQL, **records.ORACLE_SQL, **labels.ORACLE_SQL, **progress.ORACLE_SQL, **repair.ORACLE_SQL, **clean.ORACLE_SQL, **sections.ORACLE_SQL, **geometry.ORACLE_SQL, **lessons.ORACLE_SQL, **importing.ORACLE_SQL, **store.ORACLE_SQL, **reading.ORACLE_SQL}
