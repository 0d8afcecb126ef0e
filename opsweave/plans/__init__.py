"""Registered queries, one module per family."""

from importlib import import_module

from opsweave.plans.registry import ENTRIES

_FAMILIES = (
    "policy", "logs", "metrics", "correlation", "inventory", "codegraph", "graphs", "search",
    "alerts", "paths", "collab", "sources", "sinks",
)


def load_all() -> dict:
    for family in _FAMILIES:
        import_module(f"opsweave.plans.{family}")
    return ENTRIES
