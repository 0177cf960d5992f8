"""Queries on the driver's tables by name: (callable, equivalent DuckDB SQL or None)."""

from __future__ import annotations

MODULES = ("q_gaps", "q_winter", "q_assess", "q_labels", "q_shape", "q_stats", "q_monitor", "q_misc", "q_profiles", "q_seasons")
_QUERIES: dict = {}


def query(name: str, sql: str | None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""
    def put(run):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = (run, sql)
        return run

    return put


def load() -> dict:
    """All queries; importing their modules registers them."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"tidemark.plans.{name}")
    return dict(_QUERIES)
