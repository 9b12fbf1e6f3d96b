"""Registered queries over the test tables and their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every query module and return (queries, oracle SQL)."""
    from anchorgrid.plans import registry

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLES
