"""Registered queries over the driver tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("browse", "structure", "audits", "imputes", "daily", "merges", "doses", "matching", "imports", "repairs", "templates", "chains", "reference")


def load_queries() -> None:
    for module in MODULES:
        import_module(f"trencher.plans.{module}")
