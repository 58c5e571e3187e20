"""Registered queries over the driver tables, one module per family."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    for module in pkgutil.iter_modules(__path__):
        if module.name not in ("registry", "shapes"):
            importlib.import_module(f"{__name__}.{module.name}")
    return dict(QUERIES)
