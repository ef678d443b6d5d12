"""Queries over the driver's tables and the SQL that checks them, by name."""

from __future__ import annotations

from codecorpus.queries import graph, inventory, jobs, plan, quality, reports, text, whole

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (inventory, text, graph, quality, plan, jobs, reports, whole):
    for _name, (_run, _sql) in _module.ALL.items():
        QUERIES[_name] = _run
        if _sql:
            ORACLE[_name] = _sql
