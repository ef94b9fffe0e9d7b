"""The operators run over the driver tables, each with the SQL of its result."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("reports", "prices", "logs", "streams", "upkeep")


def all_queries():
    out = {}
    for name in _MODULES:
        out.update(import_module(f".{name}", __name__).QUERIES)
    return out


def all_oracles():
    out = {}
    for name in _MODULES:
        out.update(import_module(f".{name}", __name__).ORACLES)
    return out
