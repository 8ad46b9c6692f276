"""All registered queries with their SQL."""

from __future__ import annotations

from quillstone.plans import queries_notes, queries_serve, queries_text

MODULES = (queries_text, queries_notes, queries_serve)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
