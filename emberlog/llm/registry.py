"""The queries of this subpackage, and SQL twins where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("licenses", "quality", "topk", "decontaminate", "substring_dedup", "suffix_dedup", "simhash", "katz", "html_text", "mixing", "warc", "filter_audit", "clustering")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f".{m}", __package__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(import_module(f".{m}", __package__), "ORACLES", {}).items()}
