"""Registered queries: the operators of the library applied to the driver's tables, each beside its oracle."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every plan module, so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
