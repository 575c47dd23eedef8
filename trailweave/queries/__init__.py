"""Registered queries over the star-schema log, and their DuckDB SQL."""

from . import analyses, expressions, models, tables, trees

_PARTS = (trees, expressions, analyses, models, tables)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL = {name: q for part in _PARTS for name, q in part.SQL.items()}
