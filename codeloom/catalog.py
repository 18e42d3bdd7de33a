"""All queries of the library but those of the training-data subpackage."""

from __future__ import annotations

import importlib

from . import registry

MODULES = ("operators.search", "operators.traversal", "plans.rules", "plans.commands", "operators.vectors", "operators.vector_index", "operators.topology", "streaming.maintenance", "sources.discovery", "sources.python_code", "sources.resolution", "sources.layout", "operators.hybrid", "operators.exports", "sources.scip", "sources.changes", "sources.structure", "streaming.live")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, registry.Runner]:
    _load()
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
