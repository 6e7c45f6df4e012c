"""Named queries over the given tables, each with reference SQL where SQL can state it."""

from importlib import import_module

from .registry import QUERIES, SQL

for _area in ("metering", "privacy", "access", "finops", "retrieval", "governance", "streams"):
    import_module(f"{__name__}.{_area}")

__all__ = ["QUERIES", "SQL"]
