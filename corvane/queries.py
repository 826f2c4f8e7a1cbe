"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import chat, contracts, dedupe, distill, evaluate, formats, ledger, records, report

_MODULES: tuple = (chat, contracts, dedupe, distill, evaluate, formats, ledger, records, report)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the core."""
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
