"""Registered queries of the operators in this folder, one module each, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op01", "op02", "op03", "op04", "op05", "op06", "op07", "op08", "op09", "op10", "op11", "op12", "op13")


def families():
    return [import_module(f"{__name__}.{name}") for name in MODULES]
