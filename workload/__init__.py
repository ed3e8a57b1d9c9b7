"""Queries over the benchmark tables, one per operator, each with its SQL counterpart."""

from importlib import import_module

MODULES = ("features", "catalogs", "walks", "tiles")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"workload.{name}")
