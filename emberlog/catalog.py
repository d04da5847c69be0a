"""The queries of this library by name, and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("patterns", "inputs", "semantics", "signals", "reviews", "arbitration", "records", "bundles", "decisions")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"emberlog.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"emberlog.plans.{m}").ORACLES.items()}
