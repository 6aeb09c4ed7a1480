"""Registered queries over a data folder."""
from __future__ import annotations

import importlib
import pkgutil


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL, by name."""
    from statuta.plans import registry

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLES
