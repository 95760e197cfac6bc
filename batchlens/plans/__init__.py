"""Registered queries, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil

from batchlens.plans import registry


def _load() -> None:
    for mod in pkgutil.iter_modules(__path__):
        if mod.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{mod.name}")


def all_queries():
    _load()
    return dict(registry.QUERIES)


def all_oracles():
    _load()
    return {name: registry.with_ctes(*parts) for name, parts in registry.ORACLES.items()}
