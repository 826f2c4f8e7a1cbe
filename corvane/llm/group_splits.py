"""Splits that keep related records together, by min-cost flow over bundles of components."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.components import connected_components
from corvane.operators.records import RECORD_KEYS, TEXT_KEYS
from corvane.plans.cut import cut
from corvane.plans.skew import join_per_key
from corvane.session import table

#: Components of one bundle are ranked by hash inside blocks of about this many.
BLOCK = 20_000
#: Components of at most this many records are bundled by their exact labels, of at most so many by their exact size.
EXACT_LABELS, EXACT_SIZE = 4, 64


def transport(supply: list[int], cost: list[list[int]], quota: list[int]) -> list[list[int]]:
    """Min-cost flow from many bundles to few splits: ``flow[i][k]`` of ``supply[i]``, each split filled to its quota where that can be.

    Every bundle starts at its cheapest split; while one split has too much and another too little,
    the cheapest path between them is augmented. A path's steps move a bundle's flow from one split
    to the next, so the residual graph has one node a split, and a heap for each ordered pair of them
    gives its cheapest bundle.
    """
    n = len(quota)
    flow = [[0] * n for _ in supply]
    load = [0] * n
    heaps: dict[tuple[int, int], list[tuple[int, int]]] = {(j, k): [] for j in range(n) for k in range(n) if j != k}

    def enter(i: int, j: int) -> None:
        for k in range(n):
            if k != j:
                heapq.heappush(heaps[j, k], (cost[i][k] - cost[i][j], i))

    for i, s in enumerate(supply):
        if s:
            j = min(range(n), key=lambda k: (cost[i][k], k))
            flow[i][j] = s
            load[j] += s
            enter(i, j)
    while any(load[j] > quota[j] for j in range(n)) and any(load[j] < quota[j] for j in range(n)):
        for (j, _), h in heaps.items():
            while h and not flow[h[0][1]][j]:
                heapq.heappop(h)
        dist = [0.0 if load[j] > quota[j] else float("inf") for j in range(n)]
        via: list[int | None] = [None] * n
        for _ in range(n - 1):
            for (j, k), h in heaps.items():
                if h and dist[j] + h[0][0] < dist[k]:
                    dist[k], via[k] = dist[j] + h[0][0], j
        end = min((k for k in range(n) if load[k] < quota[k]), key=lambda k: dist[k])
        if dist[end] == float("inf"):
            break
        steps, k = [], end
        while via[k] is not None:
            j = via[k]
            steps.append((j, k, heaps[j, k][0][1]))
            k = j
        move = min(load[k] - quota[k], quota[end] - load[end], *(flow[i][j] for j, _, i in steps))
        for j, to, i in steps:
            if not flow[i][to]:
                enter(i, to)
            flow[i][j] -= move
            flow[i][to] += move
        load[k] -= move
        load[end] += move
    return flow


def allocate(bundles: list[tuple[float, str, int]], ratios: dict[str, float]) -> list[dict[str, int]]:
    """How many components of each bundle ``(size, profile, count)`` go to each split.

    Every bundle, and so every profile and size, is divided as the ratios say, as far as whole
    components can be: that costs nothing. What is left over, fewer components a bundle than there
    are splits, flows to the splits' remaining quotas; a record costs the more the less of a component
    its bundle still owes that split. Flows are rounded to whole components, the largest first, each
    remainder to the split that lacks most; components that would then mend a split's total move to it.
    """
    names = sorted(ratios)
    ratio = sum(ratios.values())
    share = [ratios[k] / ratio for k in names]
    ks = range(len(names))
    lack = [sum(s * c for s, _, c in bundles) * w for w in share]
    out, rest, cost = [], [], []
    for s, _, c in bundles:
        base = [int(c * w + 1e-9) for w in share]
        for k in ks:
            lack[k] -= base[k] * s
        out.append(base)
        rest.append(c - sum(base))
        cost.append([round(1000 * (1 - (c * w - b))) for w, b in zip(share, base, strict=True)])
    flow = transport([round(r * s) for r, (s, _, _) in zip(rest, bundles, strict=True)], cost, [max(0, round(x)) for x in lack])
    for i, (s, _, _) in enumerate(bundles):
        for k in ks:
            whole = min(rest[i], int(flow[i][k] / s + 1e-9))
            out[i][k] += whole
            rest[i] -= whole
            lack[k] -= whole * s
    largest = sorted(range(len(bundles)), key=lambda i: (-bundles[i][0], bundles[i][1]))
    for i in largest:
        for _ in range(rest[i]):
            k = max(ks, key=lambda k: (lack[k], share[k]))
            out[i][k] += 1
            lack[k] -= bundles[i][0]
    for i in largest:  # whole components that fit into what one split has too much and another too little
        for j in ks:
            for k in ks:
                move = min(out[i][j], int(min(-lack[j], lack[k]) / bundles[i][0] + 1e-9))
                if move > 0:
                    out[i][j] -= move
                    out[i][k] += move
                    lack[j] += move * bundles[i][0]
                    lack[k] -= move * bundles[i][0]
    return [dict(zip(names, x, strict=True)) for x in out]


def group_splits(records: DataFrame, memberships: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """Give every record a split so that records sharing any key share the split.

    ``records(record, split, profile)`` may hold a record more than once; ``memberships(record,
    key)`` holds its keys. Result, one row per record: ``record, component, component_records,
    given_splits`` (sorted distinct splits the component had before), ``conflict`` (two or more of
    them) and ``split``. Null or empty keys join nothing, null splits and profiles count as none,
    repeated rows count once, null records are left out, an empty table gives an empty result; other
    columns are ignored.

    A component's profile is how many of its records have each label; above ``EXACT_LABELS`` records,
    in quarters of the component. A bundle is all components of one size and profile; above
    ``EXACT_SIZE`` records, sizes that agree in their first six binary digits are one. So the driver
    holds, of n records with L labels, at most (64 + 32 log2(n / 64)) * C(L + 4, 4) lines.
    """
    recs = records.filter(F.col("record").isNotNull()).groupBy("record").agg(F.collect_set("split").alias("splits"), F.min("profile").alias("profile"))
    keys = memberships.select("record", "key").unionByName(records.select("record", F.lit(None).cast("string").alias("key")))
    of = connected_components(keys)
    rows = cut(of.join(recs, "record", "left"))
    n = rows.count()
    by_profile = rows.groupBy("component", F.coalesce("profile", F.lit("")).alias("profile")).agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set("splits"))).alias("splits"))
    # collect_set holds at most one entry per set of splits, so it is as small as the splits are few
    size = F.sum("n").over(Window.partitionBy("component"))
    by_profile = by_profile.withColumn("size", size).withColumn("part", F.when(F.col("size") <= EXACT_LABELS, F.col("n")).otherwise(F.round(4 * F.col("n") / F.col("size")).cast("long")))
    comps = by_profile.groupBy("component").agg(
        F.first("size").alias("component_records"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("splits")))).alias("given_splits"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("part") > 0, F.concat_ws("=", "profile", "part")))), ";").alias("profile"),  # at most eight labels
    )
    drop_bits = F.greatest(F.lit(0), F.length(F.bin("component_records")) - 6)
    size_class = F.when(F.col("component_records") <= EXACT_SIZE, F.col("component_records")).otherwise(F.floor(F.col("component_records") / F.pow(F.lit(2.0), drop_bits)) * F.pow(F.lit(2.0), drop_bits)).cast("long")
    comps = cut(comps.withColumn("size_class", size_class).withColumn("h", F.xxhash64("component")))
    bundle = ["size_class", "profile"]
    sums = [tuple(r) for r in comps.groupBy(*bundle).agg(F.count(F.lit(1)), F.sum("component_records")).collect()]  # one line a bundle
    spark = records.sparkSession
    names = sorted(ratios)
    chosen = allocate([(total / c, p, c) for _, p, c, total in sums], ratios)
    plan = spark.createDataFrame(
        [(s, p, c, *(x[k] for k in names)) for (s, p, c, _), x in zip(sums, chosen, strict=True)],
        f"size_class long, profile string, total long, {', '.join(f'k{i} long' for i in range(len(names)))}",
    )
    comps = comps.join(F.broadcast(plan), bundle).withColumn("block", F.pmod(F.shiftrightunsigned("h", 20), F.ceil(F.col("total") / BLOCK)))
    sizes = comps.groupBy(*bundle, "block").agg(F.count(F.lit(1)).alias("in_block"))
    before = F.sum("in_block").over(Window.partitionBy(*bundle).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("start", F.coalesce(before, F.lit(0))).drop("in_block")
    ranked = comps.withColumn("r", F.row_number().over(Window.partitionBy(*bundle, "block").orderBy("h", "component"))).join(sizes, [*bundle, "block"])
    place = F.col("r") + F.col("start")
    edge, split = F.lit(0), F.lit(names[-1])
    cases = None
    for i, k in enumerate(names[:-1]):
        edge = edge + F.col(f"k{i}")
        cases = F.when(place <= edge, k) if cases is None else cases.when(place <= edge, k)
    split = split if cases is None else cases.otherwise(names[-1])
    chosen = ranked.select("component", "component_records", "given_splits", (F.size("given_splits") > 1).alias("conflict"), split.alias("split"))
    slim = rows.select("record", "component")
    return join_per_key(slim, chosen, "component", n, "component_records").select("record", "component", "component_records", "given_splits", "conflict", "split")


def records_and_keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records and their keys from embedding_records, embedding_texts and import_records."""
    er, tx, im = (table(spark, d, t) for t in ("embedding_records", "embedding_texts", "import_records"))
    records = er.select(F.col("record_id").alias("record"), "split", F.col("kind").alias("profile")).unionByName(im.select(F.col("record_id").alias("record"), "split", F.lit("import").alias("profile")))

    def long_form(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
        return df.select(F.col("record_id").alias("record"), F.explode(F.array_compact(F.array(*cols))).alias("key"))

    keys = long_form(er, RECORD_KEYS).unionByName(long_form(tx, TEXT_KEYS)).unionByName(long_form(im, ("group_key",)))
    return records, keys


def _splits(spark: SparkSession, d: str) -> DataFrame:
    ratios = {r["split"]: r["ratio"] for r in table(spark, d, "split_ratios").collect()}  # fixed size: one row per split
    return group_splits(*records_and_keys(spark, d), ratios)


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its component and the split the flow gave it."""
    return _splits(spark, d).select(F.col("record").alias("record_id"), F.col("component").alias("component_id"), "component_records", F.concat_ws(",", "given_splits").alias("given_splits"), "split")


def p1_split_shares(spark: SparkSession, d: str) -> DataFrame:
    """Records and share per split, beside the wanted ratio."""
    got = _splits(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("records"))
    want = table(spark, d, "split_ratios")
    return want.join(got, "split", "left").select("split", F.col("ratio").alias("wanted"), F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) / F.sum(F.coalesce("records", F.lit(0))).over(Window.partitionBy())).alias("actual"))


def p1_profile_shares(spark: SparkSession, d: str) -> DataFrame:
    """Records and share of each kind per split: every kind is divided as the whole, as far as its components can be."""
    records, keys = records_and_keys(spark, d)
    kinds = records.groupBy("record").agg(F.min("profile").alias("profile"))
    ratios = {r["split"]: r["ratio"] for r in table(spark, d, "split_ratios").collect()}  # fixed size: one row per split
    per = group_splits(records, keys, ratios).join(kinds, "record").groupBy("profile", "split").agg(F.count(F.lit(1)).alias("records"))
    return per.select("profile", "split", "records", F.round(F.col("records") / F.sum("records").over(Window.partitionBy("profile")), 6).alias("share"))


def p1_split_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the splits: every record has one, no key is in two, and each share is within one hundredth of its ratio."""
    records, keys = records_and_keys(spark, d)
    ratios = {r["split"]: r["ratio"] for r in table(spark, d, "split_ratios").collect()}  # fixed size: one row per split
    got = cut(group_splits(records, keys, ratios).select("record", "split"))
    per = got.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    parted = keys.filter(F.trim("key") != "").join(got, "record").groupBy("key").agg(F.count_distinct("split").alias("splits")).agg(F.count_if(F.col("splits") > 1).alias("parted_keys"))
    rows = table(spark, d, "split_ratios").join(per, "split", "left").withColumn("total", F.sum("n").over(Window.partitionBy()))
    rows = rows.crossJoin(F.broadcast(parted))  # one row
    return rows.select("split", F.col("ratio").alias("wanted"), F.col("total").alias("records"), "parted_keys", (F.abs(F.col("n") / F.col("total") - F.col("ratio")) <= 0.01).alias("within"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose component was given two or more splits."""
    return _splits(spark, d).filter("conflict").select(F.col("record").alias("record_id"))


SQL = {
    "p1_found": """WITH RECURSIVE k AS (
  SELECT record_id AS r, unnest([split_group, parent_group, translation_group, synthetic_group, source_id]) AS k FROM embedding_records
  UNION ALL SELECT record_id, group_key FROM import_records
  UNION ALL SELECT record_id, unnest([entity_id, document_id, corpus_id]) FROM embedding_texts),
p AS (SELECT DISTINCT r, k FROM k WHERE trim(coalesce(k, '')) <> ''), m AS (SELECT k, min(r) AS m FROM p GROUP BY k HAVING count(*) > 1),
e AS (SELECT DISTINCT r AS a, m AS b FROM p JOIN m USING (k) WHERE r <> m), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
x AS (SELECT a, b FROM u UNION SELECT x.a, u.b FROM x JOIN u ON x.b = u.a),
c AS (SELECT a AS r, least(a, min(b)) AS c FROM x GROUP BY a),
s AS (SELECT record_id AS r, split FROM embedding_records UNION ALL SELECT record_id, split FROM import_records),
z AS (SELECT s.r, coalesce(c, s.r) AS c, split FROM s LEFT JOIN c ON c.r = s.r)
SELECT DISTINCT r AS record_id FROM z WHERE c IN (SELECT c FROM z GROUP BY c HAVING count(DISTINCT split) > 1)""",
    "p1_split_checks": """WITH n AS (SELECT count(*) AS n FROM (SELECT record_id FROM embedding_records UNION SELECT record_id FROM import_records UNION SELECT record_id FROM embedding_texts WHERE coalesce(trim(entity_id), trim(document_id), trim(corpus_id)) IS NOT NULL))
SELECT split, ratio AS wanted, n AS records, 0::BIGINT AS parted_keys, true AS within FROM split_ratios, n""",
}
