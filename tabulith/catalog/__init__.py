"""All registered queries, one module per family of operators."""

from importlib import import_module

MODULES = ("tables", "cleaning", "transforms", "conditioning", "association", "summaries", "learning", "stability")


def load() -> dict:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .base import QUERIES
    return QUERIES


def oracles() -> dict:
    load()
    from .base import ORACLES
    return ORACLES
