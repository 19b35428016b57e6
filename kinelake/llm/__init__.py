"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "chat", "substring", "bpe", "exact_dedup", "minhash", "token_shards", "avi", "mixing", "toxicity", "search", "runs", "packing")


def queries() -> dict:
    return {m.NAME: m.query for m in (import_module(f".{x}", __name__) for x in MODULES)}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in (import_module(f".{x}", __name__) for x in MODULES) if m.SQL}
