"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import atlas, geometry, segments, structures, vector

_PARTS = (vector, segments, geometry, structures, atlas)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
