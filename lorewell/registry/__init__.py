"""Registered queries over the given tables."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("sources_and_text", "rules_and_crawl", "index_and_search", "reports", "streams", "scaled")


def load():
    """(queries, comparison SQL) of all families."""
    from lorewell.registry import core

    for family in FAMILIES:
        import_module(f"lorewell.registry.{family}")
    return core.QUERIES, core.ORACLES
