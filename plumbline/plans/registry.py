"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("ingest", "explore", "statistics", "ledger", "audit", "learning", "nested", "review")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in _MODULES:
        entries = getattr(import_module(f"plumbline.plans.{name}"), attribute)
        clash = merged.keys() & entries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged |= entries
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
