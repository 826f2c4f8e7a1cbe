"""Queries of the ten training-data problems, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import answer_defects, format_duplicates, group_splits, language, mixing, packing, personal_data, split_overlap, token_budget, vector_neighbours

_MODULES = (answer_defects, group_splits, format_duplicates, split_overlap, vector_neighbours, language, personal_data, packing, mixing, token_budget)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every ``pN_...`` function of the operators' modules."""
    import re

    return {name: f for m in _MODULES for name, f in vars(m).items() if re.match(r"p\d+_", name)}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
