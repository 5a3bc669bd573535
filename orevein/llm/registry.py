"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = [
    "exact_dedup",
    "source_mix",
    "url_rules",
    "langid",
    "quality",
    "bpe",
    "near_dedup",
    "lattice",
    "paragraph_dedup",
    "suffix_dedup",
]


def _modules():
    return [import_module(f"orevein.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _modules() for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
