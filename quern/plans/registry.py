"""Named queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

from quern.plans import curation, evals, graphs, measures, paths, retrieval, searching

_PARTS = (retrieval, curation, graphs, measures, evals, paths, searching)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
