"""Registered queries and the SQL that states the same."""

from strandline.plans import motifs, pipeline, reads, streams, tables

_MODULES = (reads, tables, motifs, streams, pipeline)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
