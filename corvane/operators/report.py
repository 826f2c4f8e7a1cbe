"""Evaluation reports: gates, metrics, slices, thresholds, intervals, a hash over all of it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.canonical import write_json
from corvane.functions.text import length_bucket
from corvane.operators.evaluate import bootstrap_groups, classification_metrics, correlations, regressions, retrieval_metrics, v_measure
from corvane.session import table

LIMITATION = "What a teacher was pretrained on cannot be excluded as contamination unless its provider discloses it."


def contamination_gate(eval_ids: DataFrame, ledgers: list[DataFrame], canaries: int = 0, projection_split: str | None = "train") -> None:
    """Stops with an error where canaries were found, a projection was fitted on other than train, or an evaluated ``id`` is in a ledger."""
    if canaries or projection_split != "train":
        raise ValueError("EMBED_EVAL_CONTAMINATION_GATE")
    for ledger in ledgers:
        leaked = eval_ids.select("id").join(ledger.select("id"), "id", "left_semi").distinct()
        if some := [r["id"] for r in leaked.orderBy("id").limit(20).collect()]:
            raise ValueError(f"EMBED_EVAL_LEDGER_LEAK:{','.join(map(str, some))}")


def slice_keys(queries: DataFrame) -> DataFrame:
    """``(query, slice)`` for each of a query's language, prompt, dimension and length bucket that it has."""
    named = [F.concat(F.lit(f"{n}:"), F.col(n).cast("string")) for n in ("language", "prompt", "dimension")]
    named.append(F.when(F.col("length").isNotNull(), F.concat(F.lit("length:"), length_bucket(F.col("length")))))
    return queries.select("query", F.explode(F.array_compact(F.array(*named))).alias("slice"))


def retrieval_report(scored: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(slice, metric, value)`` of retrieval over all queries (slice ``all``) and each slice of ``slice_keys``.

    ``scored(query, candidate, score)``, ``relevant(query, candidate)``, ``queries(query, language, prompt, dimension, length)``.
    """
    sliced = slice_keys(queries).unionByName(queries.select("query", F.lit("all").alias("slice")))
    got = retrieval_metrics(scored.join(sliced, "query").withColumn("query", F.struct("slice", "query")), relevant.join(sliced, "query").select(F.struct("slice", "query").alias("query"), "candidate"), k, F.col("query.slice"))
    pairs = [x for name, c in ((f"recall@{k}", "recall"), ("mrr", "mrr"), ("ndcg@10", "ndcg")) for x in (F.lit(name), F.col(c))]
    return got.select("slice", F.explode(F.create_map(*pairs)).alias("metric", "value"))


def evaluate_spec(
    spec: dict, retrieval: tuple[DataFrame, DataFrame, DataFrame] | None = None, sts: DataFrame | None = None, classification: DataFrame | None = None, clustering: DataFrame | None = None,
    baselines: DataFrame | None = None, thresholds: DataFrame | None = None, ledgers: list[DataFrame] | None = None,
) -> dict:
    """The report of an evaluation over tables: metrics, slices, intervals, what fell below its threshold, and a hash over it.

    ``spec`` names run and revisions and holds ``canaries``, ``projection_split`` and ``bootstrap`` (seed,
    samples). Ranked lists stay in their tables; the report has one line a metric, slice and threshold.
    The interval of a retrieval metric is over its queries' values.
    """
    if spec.get("version") != "1.0.0":
        raise ValueError("EMBED_EVAL_VERSION")
    if spec.get("mteb") and not spec["mteb"].get("offline"):
        raise ValueError("EMBED_EVAL_NETWORK_OPT_IN_REQUIRED")
    if retrieval is not None:
        contamination_gate(retrieval[2].select(F.col("query").cast("string").alias("id")), ledgers or [], spec.get("canaries", 0), spec.get("projection_split"))
    elif spec.get("canaries") or spec.get("projection_split") != "train":
        raise ValueError("EMBED_EVAL_CONTAMINATION_GATE")
    parts: list[DataFrame] = []
    slices: dict[str, dict[str, float]] = {}
    intervals: dict[str, dict[str, float]] = {}
    boot = spec.get("bootstrap") or {"seed": 0, "samples": 200}
    if retrieval is not None:
        for r in retrieval_report(*retrieval).collect():  # one line a slice and metric
            slices.setdefault(r["slice"], {})[r["metric"]] = r["value"]
        scored, relevant, queries = retrieval
        per = retrieval_metrics(scored, relevant, slices=F.col("query"))
        order = F.col("slice").cast("string")
        long = per.select(order.alias("pos"), F.explode(F.create_map(*(x for n, c in (("recall@10", "recall"), ("mrr", "mrr"), ("ndcg@10", "ndcg")) for x in (F.lit(n), F.col(c))))).alias("group", "value"))
        intervals = {r["group"]: {"value": r["value"], "low": r["low"], "high": r["high"]} for r in bootstrap_groups(long, boot["seed"], boot["samples"]).collect()}
    if sts is not None:
        parts.append(correlations(sts))
    if classification is not None:
        parts.append(classification_metrics(classification))
    if clustering is not None:
        parts.append(v_measure(clustering).select(F.lit("v-measure").alias("metric"), F.col("v_measure").alias("value")))
    metrics = dict(slices.pop("all", {}))
    for p in parts:
        metrics |= {r["metric"]: r["value"] for r in p.collect()}
    failures: list[str] = []
    if thresholds is not None:
        spark = thresholds.sparkSession
        own = spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double")
        base = baselines if baselines is not None else spark.createDataFrame([], "baseline string, metric string, value double")
        failures = sorted(r["metric"] for r in regressions(own, base, thresholds).filter("NOT passed").collect())
    report = {
        "version": "1.0.0", "runId": spec["run"], "status": "complete", "comparable": True, "metrics": metrics, "intervals": intervals, "slices": slices, "regression": {"passed": not failures, "failures": failures},
        "revisions": {k: spec[k] for k in ("dataset", "evaluator") if k in spec}, "contamination": {"passed": True, "teacherLimitation": LIMITATION},
    }
    return report | {"reportHash": hashlib.sha256(write_json(report).encode()).hexdigest()}


def verify_report(text: str) -> dict:
    """A report as written in JSON, if its hash is still right."""
    report = json.loads(text)
    rest = {k: v for k, v in report.items() if k != "reportHash"}
    if hashlib.sha256(write_json(rest).encode()).hexdigest() != report.get("reportHash"):
        raise ValueError("EMBED_EVAL_REPORT_TAMPER")
    return report


def model_card(text: str) -> dict:
    """What of a verified report a model card shows."""
    r = verify_report(text)
    return {"reportHash": r["reportHash"], "evaluatorRevision": r["revisions"].get("evaluator"), "datasetRevision": r["revisions"].get("dataset"), "metrics": r["metrics"], "regressionPassed": r["regression"]["passed"]}


def prefix_spearman(rows: DataFrame) -> DataFrame:
    """``rows(pos, predicted, expected)`` to ``(pos, value)``: Spearman over all rows up to each; for small evaluation sets only, as the work is quadratic."""
    pairs = rows.select(F.col("pos").alias("end")).join(rows, F.col("pos") <= F.col("end"))
    w = lambda c: F.rank().over(Window.partitionBy("end").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("end", c)) - 1) / 2
    ranked = pairs.withColumn("x", w("predicted")).withColumn("y", w("expected"))
    m = Window.partitionBy("end")
    d = ranked.withColumn("dx", F.col("x") - F.avg("x").over(m)).withColumn("dy", F.col("y") - F.avg("y").over(m))
    s = d.groupBy(F.col("end").alias("pos")).agg(F.sum(F.col("dx") * F.col("dy")).alias("n"), F.sqrt(F.sum(F.col("dx") * F.col("dx")) * F.sum(F.col("dy") * F.col("dy"))).alias("q"))
    return s.select("pos", F.when(F.col("q") == 0, 0.0).otherwise(F.col("n") / F.col("q")).alias("value"))


def _slices(s: SparkSession, d: str) -> DataFrame:
    from corvane.operators.evaluate import _similar

    scored, relevant = _similar(s, d)
    queries = scored.select("query", "ql").distinct().select("query", F.when(F.col("ql") % 2 == 0, "en").otherwise("de").alias("language"), F.when(F.col("query") % 200 == 0, "on").otherwise("off").alias("prompt"), F.lit(64).alias("dimension"), (F.col("query") % 1500).alias("length"))
    return retrieval_report(scored.select("query", "candidate", "score"), relevant, queries)


QUERIES = {"evaluation_slices": _slices}


def _sql() -> str:
    from corvane.operators.evaluate import _RET

    return f"""{_RET}, k AS (SELECT p.query, hits / n AS recall, 1.0::DOUBLE / first AS mrr, dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS ndcg,
 unnest(['all', 'language:' || CASE WHEN ql % 2 = 0 THEN 'en' ELSE 'de' END, 'prompt:' || CASE WHEN p.query % 200 = 0 THEN 'on' ELSE 'off' END, 'dimension:64', 'length:' || CASE WHEN p.query % 1500 < 128 THEN 'short' WHEN p.query % 1500 < 1024 THEN 'medium' ELSE 'long' END]) AS slice FROM p WHERE n > 0),
g AS (SELECT slice, round(avg(recall), 9) AS recall, round(avg(mrr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg FROM k GROUP BY 1)
SELECT slice, 'recall@10' AS metric, recall AS value FROM g UNION ALL SELECT slice, 'mrr', mrr FROM g UNION ALL SELECT slice, 'ndcg@10', ndcg FROM g"""


SQL = {"evaluation_slices": _sql()}
