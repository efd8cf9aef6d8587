"""Adapter views on the given tables and the registered queries."""

from importlib import import_module

MODULES = ("network", "churn", "decisions", "places", "surroundings", "expansion", "learning", "grouping", "validation")


def load_queries() -> None:
    """Import every module that registers queries; importing twice registers once."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
