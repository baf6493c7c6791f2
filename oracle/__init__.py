"""DuckDB oracle SQL for the registered queries (test support, not library code)."""

from __future__ import annotations

import importlib

from oracle.views import with_views

_MODULES = ("oracle.sql_rowwise", "oracle.sql_traces", "oracle.sql_metrics", "oracle.sql_profiles",
            "oracle.sql_analytics", "oracle.sql_workloads", "oracle.sql_monitoring", "oracle.sql_modelling")


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        try:
            mod = importlib.import_module(m)
        except ModuleNotFoundError as e:
            if e.name != m:
                raise
            continue
        out.update({k: with_views(v) for k, v in mod.SQL.items()})
    return out
