"""Registered queries, one module per area."""

import importlib
import pkgutil


def load() -> None:
    """Import every module here, so that its queries register."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
