"""Registered queries and the SQL they are checked against."""

from importlib import import_module

MODULES = [
    "screens", "windows", "calendars", "decoders", "selection", "ledgers",
    "relations", "scalars", "archives", "streams",
]


def load():
    """All (queries, oracles) of the suite, in module order."""
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"suite.{name}")
        for key, (fn, sql) in module.REGISTRY.items():
            if key in queries:
                raise ValueError(f"duplicate query {key}")
            queries[key] = fn
            if sql is not None:
                oracles[key] = sql
    return queries, oracles
