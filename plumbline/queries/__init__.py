"""Registered queries over the given tables, with their SQL."""

from . import capture, core, evaluation, gates, layout, masks, placing, spatial, streams

_MODULES = (evaluation, core, spatial, capture, layout, gates, masks, placing, streams)
QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
