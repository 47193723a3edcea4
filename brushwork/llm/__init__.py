"""Operators of a training-data pipeline over text tables, one module each."""

from importlib import import_module

NAMES = ("exact", "substring", "scoring", "packing", "quality", "bpe", "language", "chat", "toxicity", "near", "variants", "ensemble", "negatives")


def _modules():
    return [import_module(f"{__name__}.{name}") for name in NAMES]


def queries():
    return {name: fn for m in _modules() for name, (fn, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _modules() for name, (_, sql) in m.QUERIES.items() if sql is not None}
