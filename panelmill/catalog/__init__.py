"""Registered queries: one per operator, each over whole tables."""

from importlib import import_module

MODULES = ["scans", "labelling", "panels", "learning", "streams"]


def _load():
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    from panelmill.catalog.base import ORACLES, QUERIES
    return QUERIES, ORACLES


def all_queries() -> dict:
    return dict(_load()[0])


def all_oracles() -> dict:
    return dict(_load()[1])
