"""Connected components of records that share keys, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.plans.cut import cut, drop
from corvane.plans.skew import join_per_key


def _toward_least(edges: DataFrame, n_edges: int, small: bool) -> DataFrame:
    """One star round over ``edges(u, v)`` with ``u > v``: neighbours hang onto the least of them.

    Small stars look at each node's lesser neighbours, large stars at all of them; in both the
    least is a partial aggregate, and only edges of hubs with many edges need the broadcast way.
    """
    if small:
        near = edges
        least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
        moved = join_per_key(near, least, "u", n_edges, "deg").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg")).withColumn("m", F.least("m", "u"))
    moved = join_per_key(near.filter("v > u"), least, "u", n_edges, "deg")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _stats(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def connected_components(memberships: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``memberships(record, key)`` to ``(record, component)``, component = least record in it.

    Records that share a key, directly or over other records, get the same component. Null or
    empty keys join nothing; a record with only such keys is its own component; null records
    are left out. An empty input gives an empty result. Hot keys and hubs of any size are
    handled: every per-key value is a partial aggregate and hot joins go by bounded broadcast.
    Star contraction needs about log(diameter) rounds; each round's edges are cut to a table.
    """
    m = memberships.filter(F.col("record").isNotNull())
    every = cut(m.select("record", F.when(F.trim("key") != "", F.col("key")).alias("key")).distinct())
    pairs = every.filter("key IS NOT NULL")
    per_key = pairs.groupBy("key").agg(F.min("record").alias("m"), F.max("record").alias("x"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = cut(per_key)
    n_pairs = every.count()
    two = keys.filter("n = 2").select(F.col("x").alias("u"), F.col("m").alias("v"))
    many = join_per_key(pairs, keys.filter("n > 2").select("key", "m", "n"), "key", n_pairs, "n").select(F.col("record").alias("u"), F.col("m").alias("v"))
    edges = cut(two.unionByName(many).filter("u > v").distinct())
    now = _stats(edges)
    for _ in range(max_rounds):
        if not now[0]:
            break
        big = cut(_toward_least(edges, 2 * now[0], small=False))
        drop(edges)
        edges = cut(_toward_least(big, now[0], small=True))
        drop(big)
        before, now = now, _stats(edges)
        if before == now:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    drop(keys)
    records = every.select("record").distinct()
    found = records.join(edges.withColumnRenamed("u", "record").withColumnRenamed("v", "component"), "record", "left")
    return found.select("record", F.coalesce("component", "record").alias("component"))
