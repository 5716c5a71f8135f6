"""Queries over the given tables, each next to the SQL its result must equal."""

from importlib import import_module

AREAS = ("sales", "quality", "metrics", "governance", "catalogue", "texts", "models")


def load_all():
    """The registry with the queries of every area."""
    for area in AREAS:
        import_module(f"oracle.{area}")
    return import_module("oracle.registry")
