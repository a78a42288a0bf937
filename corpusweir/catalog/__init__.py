"""Named queries over the given tables, one module per part of the library."""

import importlib
import pkgutil


def load():
    """Import every module of the catalog; returns (queries, checking SQL)."""
    from corpusweir.catalog import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLE
