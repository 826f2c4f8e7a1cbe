"""Joins that survive keys holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has at least 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys:
#: a proven bound on what is broadcast, whatever the data.
HOT_SHARE = 1000


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, n_rows: int, count_col: str) -> DataFrame:
    """Inner join of many rows with a table of one row per key that carries the key's row count.

    Hot keys (at most ``HOT_SHARE`` of them) reach the rows by broadcast, so their rows are
    not shuffled; every other key has fewer than ``n_rows / HOT_SHARE`` rows and is joined by
    shuffle. ``n_rows`` is the number of rows of ``rows``.
    """
    limit = max(n_rows // HOT_SHARE, 1000)
    hot = per_key.filter(F.col(count_col) >= limit)
    cold = per_key.filter(F.col(count_col) < limit)
    b = F.broadcast(hot)
    return rows.join(b, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
