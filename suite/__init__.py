"""Registered queries with their oracle SQL, by family; ``__spark_entry__`` collects them."""

from importlib import import_module

FAMILIES = ("windows", "detection", "capture", "modelling", "reconciliation", "pipelines", "streams")


def families():
    return [import_module(f"suite.{name}") for name in FAMILIES]
