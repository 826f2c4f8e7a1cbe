"""Evaluation metrics: retrieval, correlation, classification, clustering, bootstrap, thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import cosine, length_bucket, listwise_kl, margin_mse, pairwise_logistic, softplus
from corvane.plans.ranks import running
from corvane.session import table


def rank_candidates(scored: DataFrame) -> DataFrame:
    """``scored(query, candidate, score)`` with ``rank``: score descending, candidate ascending."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate")))


def retrieval_metrics(scored: DataFrame, relevant: DataFrame, k: int = 10, slices: Column | None = None) -> DataFrame:
    """Mean recall@k, MRR and nDCG@10 over queries, of all or of each slice.

    ``scored(query, candidate, score)``, ``relevant(query, candidate)``; recall divides by all relevant
    candidates, MRR looks at the whole list, nDCG at ten whatever k. ``slices`` is a column of ``scored``.
    """
    r = rank_candidates(scored).join(relevant.select("query", "candidate").distinct().withColumn("_hit", F.lit(1)), ["query", "candidate"], "left")
    n = relevant.select("query", "candidate").distinct().groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    keys = ["query"] if slices is None else ["query", slices.alias("slice")]
    gain = F.when(F.col("_hit").isNotNull(), 1.0 / F.log2(F.col("rank") + 1))
    per = r.groupBy(*keys).agg(F.count_if((F.col("rank") <= k) & F.col("_hit").isNotNull()).alias("hits"), F.min(F.when(F.col("_hit").isNotNull(), F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= 10, gain)).alias("dcg")).join(n, "query")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n")).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    per = per.select(*([] if slices is None else ["slice"]), (F.col("hits") / F.col("n")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))
    agg = [F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(c), 9).alias(c) for c in ("recall", "mrr", "ndcg"))]
    return per.agg(*agg) if slices is None else per.groupBy("slice").agg(*agg)


def average_ranks(df: DataFrame, c: str, out: str) -> DataFrame:
    """Fractional ranks, ties share the mean; over value counts, so equal values of any number are one row of the sort."""
    counts = running(df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), [F.col(c)], F.col("_n"), "_before")
    return df.join(counts.select(c, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out)), c)


def correlations(pairs: DataFrame) -> DataFrame:
    """Pearson and Spearman of ``pairs(predicted, expected)``; 0 where one does not vary."""

    def pearson(d: DataFrame, x: str, y: str, name: str) -> DataFrame:
        m = d.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
        dx, dy = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
        s = d.crossJoin(F.broadcast(m)).agg(F.sum(dx * dy).alias("n"), F.sqrt(F.sum(dx * dx) * F.sum(dy * dy)).alias("q"))  # one row of means
        return s.select(F.lit(name).alias("metric"), F.round(F.when(F.col("q") == 0, 0.0).otherwise(F.col("n") / F.col("q")), 9).alias("value"))

    p = pairs.select(F.col("predicted").cast("double"), F.col("expected").cast("double")).filter("predicted IS NOT NULL AND expected IS NOT NULL")
    ranked = average_ranks(average_ranks(p, "predicted", "rp"), "expected", "re")
    return pearson(p, "predicted", "expected", "pearson").unionByName(pearson(ranked, "rp", "re", "spearman"))


def classification_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy and macro F1 over all labels of ``rows(predicted, expected)``, from one confusion table."""
    c = rows.groupBy("predicted", "expected").agg(F.count(F.lit(1)).alias("n"))
    sides = c.select(F.col("predicted").alias("label"), F.when(F.col("predicted") == F.col("expected"), F.col("n")).otherwise(0).alias("tp"), "n").unionByName(c.select(F.col("expected").alias("label"), F.lit(0).cast("long").alias("tp"), "n"))
    f1 = sides.groupBy("label").agg((2 * F.sum("tp") / F.sum("n")).alias("f1")).agg(F.lit("macro-f1").alias("metric"), F.round(F.avg("f1"), 9).alias("value"))
    accuracy = c.agg(F.lit("accuracy").alias("metric"), F.round(F.sum(F.when(F.col("predicted") == F.col("expected"), F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("value"))
    return accuracy.unionByName(f1)


def v_measure(rows: DataFrame) -> DataFrame:
    """V-measure of ``rows(predicted, expected)`` with natural logarithms."""
    c = rows.groupBy("predicted", "expected").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over label pairs, not rows
    w = c.select("n", total.alias("t"), F.sum("n").over(Window.partitionBy("predicted")).alias("p"), F.sum("n").over(Window.partitionBy("expected")).alias("e"))
    joint = lambda side: -F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col(side)))
    s = w.agg(joint("p").alias("ce"), joint("e").alias("cp"), (-F.sum(F.col("n") / F.col("t") * F.ln(F.col("e") / F.col("t")))).alias("he"), (-F.sum(F.col("n") / F.col("t") * F.ln(F.col("p") / F.col("t")))).alias("hp"))
    h, k = F.when(F.abs("he") < 1e-15, 1.0).otherwise(1 - F.col("ce") / F.col("he")), F.when(F.abs("hp") < 1e-15, 1.0).otherwise(1 - F.col("cp") / F.col("hp"))
    return s.select(F.round(h, 9).alias("homogeneity"), F.round(k, 9).alias("completeness"), F.round(F.when(h + k == 0, 0.0).otherwise(2 * h * k / (h + k)), 9).alias("v_measure"))


def bootstrap_interval(values: list[float], seed: int, samples: int) -> dict[str, float]:
    """Percentile interval of the mean with draws from a 32-bit linear congruential generator; for a metric's per-query values."""
    if not values:
        raise ValueError("no values")
    # Multiplier and increment of the generator.
    multiplier, increment = 1664525, 1013904223
    n = len(values)
    v = np.asarray(values, float)
    state, idx = seed & 0xFFFFFFFF, np.empty(samples * n, np.int64)
    for i in range(samples * n):
        state = (multiplier * state + increment) & 0xFFFFFFFF
        idx[i] = state * n >> 32
    draws = np.sort(v[idx].reshape(samples, n).mean(axis=1))
    return {"value": float(v.mean()), "low": float(draws[int(samples * 0.025)]), "high": float(draws[min(samples - 1, int(samples * 0.975))])}


def bootstrap_groups(rows: DataFrame, seed: int = 0, samples: int = 200) -> DataFrame:
    """``rows(group, pos, value)`` to an interval a group; a group is one metric's values, drawn in one task in order of ``pos``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = bootstrap_interval(pdf.sort_values("pos")["value"].tolist(), seed, samples)
        return pd.DataFrame([{"group": pdf["group"].iloc[0], **{k: round(v, 9) for k, v in x.items()}}])

    return rows.groupBy("group").applyInPandas(one, "group string, value double, low double, high double")


def regressions(metrics: DataFrame, baselines: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``thresholds(metric, baseline, minimum, maximum, minimum_delta)`` that ``metrics(metric, value)`` fail; unknown metrics and baselines fail."""
    t = thresholds.join(metrics, "metric", "left").join(baselines.select("baseline", "metric", F.col("value").alias("base")), ["baseline", "metric"], "left")
    v = F.col("value")
    bad = v.isNull() | F.coalesce(v < F.col("minimum"), F.lit(False)) | F.coalesce(v > F.col("maximum"), F.lit(False)) | (F.col("minimum_delta").isNotNull() & F.coalesce(v - F.col("base") < F.col("minimum_delta"), F.lit(True)))
    return t.select("metric", "baseline", (~bad).alias("passed"))


def compare_reports(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences of right from left report by metric; a metric the left lacks counts as 0 there."""
    return right.select("metric", F.col("value").alias("r")).join(left.select("metric", F.col("value").alias("l")), "metric", "left").select("metric", (F.col("r") - F.coalesce("l", F.lit(0.0))).alias("delta"))


def topk_targets(logits: DataFrame, k: int) -> DataFrame:
    """``logits(key, values array)`` to the k most probable positions and the mass that is left: ``(key, positions, probabilities, residual)``."""
    from corvane.functions.text import softmax

    p = logits.select("key", F.posexplode(softmax(F.col("values"))).alias("i", "p"))
    top = p.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("m"), "i"))), 1, k).alias("t"))
    return top.select("key", F.transform("t", lambda x: x["i"]).alias("positions"), F.transform("t", lambda x: -x["m"]).alias("probabilities"), (1 - F.aggregate("t", F.lit(0.0), lambda s, x: s - x["m"])).alias("residual"))


#: Queries that one task compares its candidates with at a time, and parts that each block of queries' candidates are cut into.
BLOCK_QUERIES, PARTS = 2_000, 32


def score_all(queries: DataFrame, candidates: DataFrame, n_queries: int) -> DataFrame:
    """``queries(query, x, ...)`` against all ``candidates(candidate, y, ...)`` in blocks: every pair once, with its cosine.

    A task holds at most about ``BLOCK_QUERIES`` queries and one part of the candidates; nothing is broadcast.
    """
    blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    q = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    c = candidates.withColumn("part", F.pmod(F.xxhash64("candidate"), F.lit(PARTS)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return c.join(q.hint("shuffle_hash"), ["block", "part"]).withColumn("score", F.round(cosine(F.col("x"), F.col("y")), 9)).drop("block", "part", "x", "y")


def _similar(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector against all others; relevant are those of its label."""
    e = table(s, d, "embeddings").filter("embedding IS NOT NULL")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("x"), F.col("label").alias("ql"))
    pairs = score_all(q, e.select(F.col("vec_id").alias("candidate"), F.col("embedding").alias("y"), "label"), q.count()).filter("query <> candidate")
    scored = pairs.select("query", "candidate", "score", "ql", (F.col("label") == F.col("ql")).alias("rel"))
    return scored, scored.filter("rel").select("query", "candidate")


_LINES = "SELECT round(l_discount * 10, 6) AS a, round(l_tax * 10, 6) AS b FROM lineitem"


def _losses(s: SparkSession, d: str) -> DataFrame:
    a, b = F.round(F.col("l_discount") * 10, 6), F.round(F.col("l_tax") * 10, 6)
    x = table(s, d, "lineitem").select(a.alias("a"), b.alias("b"))
    mean = lambda c, n: F.round(F.avg(c), 9).alias(n)
    return x.agg(mean(F.pow(F.col("a") - F.col("b"), F.lit(2.0)), "mse"), mean(F.abs(F.col("a") - F.col("b")), "mae"), mean(pairwise_logistic(F.col("a"), F.col("b")), "pairwise_logistic"), mean(softplus(-0.1 * (F.col("a") - F.col("b"))), "preference"), mean(margin_mse(F.col("a"), F.col("b"), F.lit(0.7), F.lit(0.1)), "margin_mse"))


QUERIES = {
    "retrieval_metrics": lambda s, d: retrieval_metrics(*_similar(s, d)),
    "retrieval_slices": lambda s, d: retrieval_metrics(*_similar(s, d), slices=F.concat(F.lit("label:"), F.col("ql").cast("string"))),
    "sts_correlations": lambda s, d: correlations(table(s, d, "lineitem").select(F.col("l_quantity").alias("predicted"), F.col("l_extendedprice").alias("expected"))),
    "classification_metrics": lambda s, d: classification_metrics(table(s, d, "orders").select(F.col("o_orderstatus").alias("predicted"), F.when(F.col("o_totalprice") > 150000, "F").otherwise("O").alias("expected"))),
    "clustering_vmeasure": lambda s, d: v_measure(table(s, d, "events").select(F.col("event_type").alias("predicted"), F.floor(F.col("value") / 10).cast("string").alias("expected"))),
    "bootstrap_interval": lambda s, d: bootstrap_groups(table(s, d, "supplier").select(F.lit("acctbal").alias("group"), F.col("s_suppkey").alias("pos"), F.col("s_acctbal").alias("value"))),
    "length_buckets": lambda s, d: table(s, d, "documents").groupBy(length_bucket(F.coalesce("n_chars", F.lit(0))).alias("bucket")).agg(F.count(F.lit(1)).alias("rows")),
    "pair_losses": _losses,
    "listwise_kl": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(listwise_kl(F.slice("embedding", 1, 8).cast("array<double>"), F.slice("embedding", 9, 8).cast("array<double>")), 6).alias("kl")),
    "topk_targets": lambda s, d: topk_targets(table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("values")), 3).select("key", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"), F.round("residual", 6).alias("residual")),
    "feature_loss": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(F.aggregate(F.zip_with(F.slice("embedding", 1, 16), F.slice("embedding", 17, 16), lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))), F.lit(0.0), lambda t, x: t + x) / 16, 9).alias("mse"), F.round(1 - cosine(F.slice("embedding", 1, 16), F.slice("embedding", 17, 16)), 9).alias("one_minus_cosine")),
}
_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
_COS = f"{_DOT} / (sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')}))"
_RET = f"""WITH q AS (SELECT vec_id AS query, embedding AS x, label AS ql FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
s AS (SELECT query, ql, vec_id AS candidate, label = ql AS rel, round({_COS.format("x", "embedding")}, 9) AS score FROM embeddings, q WHERE embedding IS NOT NULL AND vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank FROM s),
p AS (SELECT query, ql, count(*) FILTER (WHERE rel) AS n, count(*) FILTER (WHERE rel AND rank <= 10) AS hits, min(rank) FILTER (WHERE rel) AS first, coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (WHERE rel AND rank <= 10), 0) AS dcg FROM r GROUP BY ALL),
v AS (SELECT ql, hits / n AS recall, 1.0::DOUBLE / first AS mrr, dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS ndcg FROM p WHERE n > 0)
"""
_MEANS = "count(*) AS queries, round(avg(recall), 9) AS recall, round(avg(mrr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg FROM v"
_SOFT = "list_transform({0}, lambda q: exp(q - list_max({0})))"
SQL = {
    "retrieval_metrics": f"{_RET} SELECT {_MEANS}",
    "retrieval_slices": f"{_RET} SELECT 'label:' || ql AS slice, {_MEANS} GROUP BY 1",
    "sts_correlations": """WITH p AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS y FROM p)
SELECT 'pearson' AS metric, round(corr(x, y), 9) AS value FROM p UNION ALL SELECT 'spearman', round(corr(x, y), 9) FROM r""",
    "classification_metrics": """WITH r AS (SELECT o_orderstatus AS p, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END AS e FROM orders), l AS (SELECT p AS label FROM r UNION SELECT e FROM r),
f AS (SELECT label, 2 * count(*) FILTER (WHERE p = label AND e = label) / (count(*) FILTER (WHERE p = label) + count(*) FILTER (WHERE e = label)) AS f1 FROM l, r GROUP BY 1)
SELECT 'accuracy' AS metric, round(avg((p = e)::INT), 9) AS value FROM r UNION ALL SELECT 'macro-f1', round(avg(f1), 9) FROM f""",
    "clustering_vmeasure": """WITH c AS (SELECT event_type AS p, floor(value / 10) AS e, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
w AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY p) AS p, sum(n) OVER (PARTITION BY e) AS e FROM c),
s AS (SELECT -sum(n / t * ln(n / p)) AS ce, -sum(n / t * ln(n / e)) AS cp, -sum(n / t * ln(e / t)) AS he, -sum(n / t * ln(p / t)) AS hp FROM w),
h AS (SELECT 1 - ce / he AS h, 1 - cp / hp AS k FROM s) SELECT round(h, 9) AS homogeneity, round(k, 9) AS completeness, round(2 * h * k / (h + k), 9) AS v_measure FROM h""",
    "length_buckets": "SELECT CASE WHEN coalesce(n_chars, 0) < 128 THEN 'short' WHEN n_chars < 1024 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS rows FROM documents GROUP BY 1",
    "pair_losses": f"""WITH x AS ({_LINES}) SELECT round(avg((a - b) ** 2), 9) AS mse, round(avg(abs(a - b)), 9) AS mae, round(avg(ln(1 + exp(-(a - b)))), 9) AS pairwise_logistic,
  round(avg(ln(1 + exp(-0.1::DOUBLE * (a - b)))), 9) AS preference, round(avg(((a - b) - (0.7::DOUBLE - 0.1::DOUBLE)) ** 2), 9) AS margin_mse FROM x""",
    "listwise_kl": f"""WITH v AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS t, embedding[9:16]::DOUBLE[] AS s FROM embeddings), e AS (SELECT vec_id, {_SOFT.format("t")} AS t, {_SOFT.format("s")} AS s FROM v),
p AS (SELECT vec_id, list_transform(t, lambda x: x / list_sum(t)) AS t, list_transform(s, lambda x: x / list_sum(s)) AS s FROM e)
SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda i: t[i] * ln(t[i] / s[i]))), 6) AS kl FROM p""",
    "topk_targets": f"""WITH e AS (SELECT vec_id AS key, {_SOFT.format("(embedding::DOUBLE[])")} AS e FROM embeddings), x AS (SELECT key, generate_subscripts(e, 1) - 1 AS i, unnest(e) / list_sum(e) AS p FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p DESC, i) AS r FROM x) SELECT key, string_agg(i::VARCHAR, ',' ORDER BY r) AS positions, round(1 - sum(p), 6) AS residual FROM r WHERE r <= 3 GROUP BY key""",
    "feature_loss": f"""SELECT vec_id, round(list_sum(list_transform(range(1, 17), lambda i: (embedding[i]::DOUBLE - embedding[i + 16]::DOUBLE) ** 2)) / 16, 9) AS mse,
  round(1 - {_COS.format("embedding[1:16]", "embedding[17:32]")}, 9) AS one_minus_cosine FROM embeddings""",
}
