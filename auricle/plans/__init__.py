"""Queries over the test tables, one module per operator group."""

from importlib import import_module

GROUPS = ("curation", "health", "ledger", "windows", "io", "splits", "gates", "evaluation", "diagnostics", "models", "decisions", "sessions", "files")


def load():
    """(queries, oracle SQL) of all groups."""
    from . import registry

    for group in GROUPS:
        import_module(f"{__name__}.{group}")
    return registry.QUERIES, registry.ORACLES
