"""Importing this package registers every query."""
import importlib
import pkgutil

from inswing.sources import fixture as _fixture  # noqa: F401
from inswing.operators import people as _people, working as _working  # noqa: F401

for _module in pkgutil.iter_modules(__path__):
    if _module.name.startswith("q_"):
        importlib.import_module(f"{__name__}.{_module.name}")
