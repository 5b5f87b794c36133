"""Every operator bound to the driver tables, with equal SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("eda", "prepare", "evaluation", "graphs", "models", "fits")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        merged.update(getattr(import_module(f"strucreg.catalog.{module}"), attribute))
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
