"""Filling containers of fixed capacity: minimum bin slack by bitset subset sums over available lengths."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.tokens import with_tokens
from corvane.plans.cut import cut
from corvane.session import table

#: Items that one task packs together, and the fill below which a container's items are packed again with others'.
GROUP_ITEMS, REPACK_BELOW = 20_000, 0.97


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths to take, out of ``lengths`` (ascending) as often as ``counts`` allows, whose sum is the greatest within ``room``.

    Reachable sums are the bits of one integer; each length is shifted in as often as it is there,
    long ones first, until the sum ``room`` is reached or no length is left.
    """
    reach, steps, goal, mask = 1, [], 1 << room, (1 << (room + 1)) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        x = lengths[i]
        for _ in range(min(counts[x], room // x)):
            new = (reach | reach << x) & mask
            if new == reach:
                break
            steps.append((x, reach))
            reach = new
            if reach & goal:
                break
        if reach & goal:
            break
    left, out = reach.bit_length() - 1, []
    for x, before in reversed(steps):
        if not before >> left & 1:
            out.append(x)
            left -= x
    return out


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item (1 <= size <= capacity): the longest item left opens one, the fullest sum completes it."""
    at: dict[int, list[int]] = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        at[sizes[i]].append(i)
    lengths = sorted(at)
    counts = {x: len(v) for x, v in at.items()}
    out, number = [0] * len(sizes), 0
    while lengths:
        first = lengths[-1]
        taken = [first]
        counts[first] -= 1
        if not counts[first]:
            lengths.pop()
        if first < capacity:
            taken += fullest(lengths, counts, capacity - first)
            for x in taken[1:]:
                counts[x] -= 1
                if not counts[x]:
                    del lengths[bisect_right(lengths, x) - 1]
        for x in taken:
            out[at[x].pop()] = number
        number += 1
    return out


def _packed(items: DataFrame, prefix: str) -> DataFrame:
    """``items(profile, capacity, key, piece, tokens, group)`` with ``bin`` and ``filled``, packed group by group."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tokens", "descending"), ("key", "ascending"), ("piece", "ascending")])
        if not t.num_rows:
            return t.append_column("bin", pa.array([], pa.string())).append_column("filled", pa.array([], pa.int64()))
        sizes, capacity = t.column("tokens").to_pylist(), t.column("capacity")[0].as_py()
        number = pack(sizes, capacity)
        filled: dict[int, int] = defaultdict(int)
        for n, s in zip(number, sizes, strict=True):
            filled[n] += s
        name = f"{t.column('profile')[0].as_py()}-{prefix}{t.column('group')[0].as_py()}-"
        return t.append_column("bin", pa.array([f"{name}{n}" for n in number])).append_column("filled", pa.array([filled[n] for n in number], pa.int64()))

    return items.groupBy("profile", "group").applyInArrow(one, "profile string, capacity long, key long, piece int, tokens long, group long, bin string, filled long")


def pack_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Put ``items(key, tokens)`` into containers of each ``limits(profile, capacity)``.

    Result: ``profile, capacity, key, piece, tokens, bin, filled``. An item stays whole (piece 0)
    unless it exceeds the capacity; then its pieces fill containers of their own but for the last,
    which is packed like an item. Groups of about ``GROUP_ITEMS`` items, by hash, are packed each in
    a task; items of containers under ``REPACK_BELOW`` full are then packed again with those of
    other groups, so what is left over does not grow with the number of groups. Items that are null
    or have no token are in no container; a key given twice is two items; capacities under 1 take
    nothing; empty tables give an empty result; other columns are ignored.
    """
    some = items.filter("tokens > 0").select("key", "tokens")
    sizes = limits.select("profile", F.col("capacity").cast("long").alias("capacity")).filter("capacity > 0").distinct()
    n = some.count()
    groups = max(1, -(-n // GROUP_ITEMS))
    every = some.crossJoin(F.broadcast(sizes))  # a few profiles, each packs all items
    pieces = every.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("tokens") / F.col("capacity")) - 1).cast("int"))))
    size = F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity"))
    pieces = pieces.withColumn("tokens", size)
    whole = pieces.filter("tokens = capacity")
    rest = pieces.filter("tokens < capacity").withColumn("group", F.pmod(F.xxhash64("key", "piece"), F.lit(groups)))
    cols = ["profile", "capacity", "key", "piece", "tokens", "bin", "filled"]
    full = whole.withColumn("bin", F.concat_ws("-", "profile", F.lit("w"), "key", "piece")).withColumn("filled", F.col("tokens")).select(*cols)
    first = cut(_packed(rest.select("profile", "capacity", "key", "piece", "tokens", "group"), "a"))
    good = F.col("filled") >= REPACK_BELOW * F.col("capacity")
    loose = first.filter(~good)
    n_loose = loose.count()
    again = _packed(loose.drop("bin", "filled").withColumn("group", F.pmod(F.xxhash64("key", "piece", F.lit(1)), F.lit(max(1, -(-n_loose // GROUP_ITEMS))))), "b")
    return full.unionByName(first.filter(good).select(*cols)).unionByName(again.select(*cols))


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return cut(with_tokens(docs, ["key"])), table(spark, d, "pack_limits").select("profile", F.col("capacity_tokens").alias("capacity"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container for each profile."""
    return pack_items(*_items(spark, d)).select("profile", F.col("key").alias("doc_id"), "piece", "tokens", "bin", "filled")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and fill by profile, beside the fewest containers that could do."""
    per = p8_packing(spark, d).join(table(spark, d, "pack_limits"), "profile").groupBy("profile").agg(F.count_distinct("bin").alias("bins"), F.sum("tokens").alias("tokens"), F.max("capacity_tokens").alias("capacity"))
    return per.select("profile", "bins", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("fill"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold by profile: every document with a token is packed, none is cut that fits, no container is over its capacity, no token is lost."""
    items, limits = _items(spark, d)
    packed = cut(pack_items(items, limits))
    bins = packed.groupBy("profile", "capacity", "bin").agg(F.sum("tokens").alias("t"), F.max("filled").alias("filled"))
    bad = bins.groupBy("profile").agg(F.count_if((F.col("t") > F.col("capacity")) | (F.col("t") != F.col("filled"))).alias("overfull"))
    per = packed.groupBy("profile", "capacity", "key").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("pieces")).join(items, "key")
    docs = per.groupBy("profile").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("tokens") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("cut"), F.count_if(F.col("t") != F.col("tokens")).alias("changed"),
    )
    return docs.join(bad, "profile").select("profile", "documents", "cut", "overfull", "changed")


SQL = {"p8_checks": "SELECT profile, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0::BIGINT AS cut, 0::BIGINT AS overfull, 0::BIGINT AS changed FROM pack_limits"}
