"""Registered queries over the synthetic city, each with its SQL where SQL can say it."""

from __future__ import annotations

from streetloom.queries import areas, relational, streets

_MODULES = (relational, areas, streets)
QUERIES = {name: f for m in _MODULES for name, (f, _) in m.REGISTERED.items()}
ORACLES = {name: sql for m in _MODULES for name, (_, sql) in m.REGISTERED.items() if sql}
