"""Call ledgers, attempts, leases, recovery, capacity, evidence chains, lineage deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.plans.cut import cut, drop
from corvane.plans.ranks import numbered
from corvane.session import table


def running_budget(calls: DataFrame, limit: float) -> DataFrame:
    """``calls(stage, seq, cost)`` with ``spent`` and whether the stage's budget holds; stages are ledgers of one run."""
    spent = F.sum("cost").over(Window.partitionBy("stage").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("spent", spent).withColumn("ok", F.col("spent") <= limit)


def cost_rollup(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by role: ``calls(role, model, input_tokens, output_tokens)``, ``prices(model, input_price, output_price)`` a million.

    Prices are few and reach the calls by broadcast; a call without a price counts in ``unpriced``.
    """
    c = calls.join(F.broadcast(prices), "model", "left")
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6
    return c.groupBy("role").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(F.coalesce(cost, F.lit(0.0))), 6).alias("cost"), F.count_if(F.col("input_price").isNull()).alias("unpriced"))


def retry_delay(attempt: Column, jitter: Column, hint_ms: Column) -> Column:
    """Back-off 100 * 2^attempt * (1 + jitter) ms, or the server's hint if larger."""
    return F.greatest(F.coalesce(hint_ms, F.lit(0)).cast("double"), F.round(100 * F.pow(F.lit(2.0), attempt) * (1 + jitter)))


def rate_windows(calls: DataFrame, every: str = "60 seconds", limit: int = 0) -> DataFrame:
    """Calls in each fixed window of ``calls(ts, ...)`` and how far over the limit they are."""
    return calls.groupBy(F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("calls")).select(F.col("w.start").alias("start"), "calls", F.greatest(F.col("calls") - limit, F.lit(0)).alias("over"))


def first_success(calls: DataFrame) -> DataFrame:
    """The first successful call of each identity, which later ones reuse: ``calls(identity, seq, ok, ...)``."""
    good = calls.filter("ok")
    return good.groupBy("identity").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("paid"))


def reconcile_batches(items: DataFrame, results: DataFrame) -> DataFrame:
    """``items(request, estimate)`` and ``results(request, seq, cost)``: first result wins, unknown requests are dropped."""
    first = results.groupBy("request").agg(F.min_by("cost", "seq").alias("cost"))
    j = items.groupBy("request").agg(F.min("estimate").alias("estimate")).join(first, "request", "left")
    return j.agg(F.count(F.lit(1)).alias("submitted"), F.count("cost").alias("completed"), F.count_if(F.col("cost").isNull()).alias("pending"), F.round(F.sum("cost"), 3).alias("cost"))


def recover_attempts(attempts: DataFrame, now: Column) -> DataFrame:
    """Running attempts whose lease has ended are retryable; ``next_attempt`` counts on: ``attempts(record, attempt, status, lease)``."""
    a = attempts.withColumn("status", F.when((F.col("status") == "running") & (F.col("lease") <= now), "failed_retryable").otherwise(F.col("status")))
    return a.groupBy("record").agg(F.max_by("status", "attempt").alias("status"), F.count(F.lit(1)).alias("attempts"), (F.count(F.lit(1)) + 1).alias("next_attempt"))


def sequence_gaps(events: DataFrame, start: int) -> DataFrame:
    """``events(run, sequence, arrival)`` whose number is not the next, counting from ``start``."""
    n = F.row_number().over(Window.partitionBy("run").orderBy("arrival"))
    return events.withColumn("expected", n - 1 + start).filter("sequence <> expected").select("run", "sequence", "expected")


def remote_jobs(events: DataFrame) -> DataFrame:
    """State of each job from its events ``(job, seq, type)``: last type, attempts started."""
    return events.groupBy("job").agg(F.max_by("type", "seq").alias("status"), F.count_if(F.col("type") == "running").alias("attempts"), F.count(F.lit(1)).alias("events"))


def illegal_transitions(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Steps of ``events(job, seq, state)`` not in ``allowed(from_state, to_state)`` (a small table)."""
    prev = F.lag("state").over(Window.partitionBy("job").orderBy("seq"))
    steps = events.withColumn("from_state", prev).filter("from_state IS NOT NULL").select("job", "seq", "from_state", F.col("state").alias("to_state"))
    return steps.join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti")


def rank_capacity(candidates: DataFrame, data_center: str, minimum: int) -> DataFrame:
    """``candidates(name, vram, data_center, hourly, available)``: fitting ones first, then by price; with the reasons against each."""
    why = F.array_compact(F.array(F.when(F.col("available") < 1, "capacity"), F.when(F.col("data_center") != data_center, "volume-locality"), F.when(F.col("vram") < minimum, "vram")))
    c = candidates.withColumn("reasons", F.array_join(why, ",")).withColumn("compatible", F.size(why) == 0)
    ranked = numbered(c.select("name", "compatible", "reasons", "hourly"), [F.desc("compatible"), F.asc("hourly"), F.asc("name")], "rank")
    return ranked.select("name", "compatible", "reasons", F.col("rank").cast("int").alias("rank"))


def recover_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """``checkpoints(run, path, step, complete, intact)``: a run's newest usable one, and how many newer ones were passed over."""
    good = F.col("complete") & F.col("intact")
    best = checkpoints.groupBy("run").agg(F.max(F.when(good, F.struct("step", "path"))).alias("best"))
    j = checkpoints.join(best, "run")
    return j.groupBy("run").agg(F.first("best.path").alias("path"), F.first("best.step").alias("step"), F.count_if(F.col("step") > F.coalesce("best.step", F.lit(-1))).alias("fallbacks"))


def reconcile_costs(runs: DataFrame) -> DataFrame:
    """``runs(run, hourly, seconds, observed_at, billed, billed_through)``: observed cost and whether billing lags."""
    lag = F.col("billed_through").isNull() | (F.col("billed_through") < F.col("observed_at"))
    return runs.select("run", F.round(F.col("hourly") * F.col("seconds") / 3600, 7).alias("observed"), "billed", lag.alias("lagging"))


def chain_breaks(links: DataFrame, genesis: str = "") -> DataFrame:
    """``links(chain, seq, digest, previous)`` that do not name the digest before them."""
    prior = F.coalesce(F.lag("digest").over(Window.partitionBy("chain").orderBy("seq")), F.lit(genesis))
    return links.withColumn("prior", prior).filter(F.coalesce("previous", F.lit("")) != F.col("prior")).select("chain", "seq")


def deletion_plan(edges: DataFrame, roots: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Assets to delete with ``roots(id)``: reachable over ``edges(parent, child)`` of assets that must go with their parent.

    Breadth first, each round's new assets cut and joined to the edges once; rounds = depth.
    """
    done = cut(roots.select("id").distinct())
    front = done
    for _ in range(max_rounds):
        new = cut(edges.join(front.withColumnRenamed("id", "parent"), "parent").select(F.col("child").alias("id")).distinct().join(done, "id", "left_anti"))
        if not new.limit(1).count():
            return done
        old = done
        done = cut(done.unionByName(new))
        drop(old)
        front = new
    raise RuntimeError(f"deeper than {max_rounds}")


def quota_deficits(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows(labels array)`` against ``rules(label, target)``: available rows and what is missing; a row counts once a label."""
    have = rows.select(F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("available"))
    return rules.join(have, "label", "left").select("label", "target", F.coalesce("available", F.lit(0)).alias("available"), F.greatest(F.lit(0), F.col("target") - F.coalesce("available", F.lit(0))).alias("deficit"))


def judge_scores(scores: DataFrame) -> DataFrame:
    """``scores(candidate, ordering, d1..d4, quality)``: means over orderings and how far they disagree; NaN never passes."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))))
    return scores.groupBy("candidate").agg(*(F.round(F.avg(clamp(F.col(c))), 9).alias(c) for c in ("d1", "d2", "d3", "d4")), F.round(F.max(clamp(F.col("quality"))) - F.min(clamp(F.col("quality"))), 9).alias("disagreement"))


def submit_within(requests: DataFrame, budget: float) -> DataFrame:
    """``requests(batch, seq, request, estimate)`` with ``outcome``: a repeated request is skipped, one that would pass the budget is refused."""
    first = F.row_number().over(Window.partitionBy("batch", "request").orderBy("seq")) == 1
    d = requests.withColumn("first", first)
    spent = F.sum(F.when(F.col("first"), F.col("estimate")).otherwise(0.0)).over(Window.partitionBy("batch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return d.select("batch", "seq", "request", F.when(~F.col("first"), "duplicate").when(spent > budget, "over-budget").otherwise("submitted").alias("outcome"))


def dispatch(tasks: DataFrame) -> DataFrame:
    """The next task of each fleet: the queued one of ``tasks(fleet, seq, task, state, owner)`` that came first, and how many wait."""
    q = F.col("state") == "queued"
    return tasks.groupBy("fleet").agg(F.min_by("task", F.when(q, F.col("seq"))).alias("task"), F.count_if(q).alias("waiting"), F.count_if(q & F.col("owner").isNotNull()).alias("owned")).filter("task IS NOT NULL")


def orphans(found: DataFrame, known: DataFrame) -> DataFrame:
    """Resources ``found(id)`` that no ``known(id)`` accounts for."""
    return found.select("id").distinct().join(known.select("id"), "id", "left_anti")


def leases(events: DataFrame) -> DataFrame:
    """Outcome of each step of ``events(lock, seq, at, owner, action, ttl)``; a lock's steps are folded in order.

    ``acquire`` is granted where the lock is free, expired or the owner's; ``renew`` and ``release`` only to
    the owner while it holds. Result ``(lock, seq, granted, holder)``.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        holder, until, out = None, -1, []
        for lock, seq, at, owner, action, ttl in pdf.sort_values("seq")[["lock", "seq", "at", "owner", "action", "ttl"]].itertuples(index=False):
            live = holder is not None and at < until
            ok = (not live or holder == owner) if action == "acquire" else live and holder == owner
            if ok:
                holder, until = (None, -1) if action == "release" else (owner, at + ttl)
            out.append((lock, seq, ok, holder if holder is not None and at < until else None))
        return pd.DataFrame(out, columns=["lock", "seq", "granted", "holder"])

    return events.groupBy("lock").applyInPandas(one, "lock string, seq long, granted boolean, holder string")


def review_breaks(reviews: DataFrame) -> DataFrame:
    """``reviews(subject, seq, decision, reviewer, previous)`` whose ``previous`` is not the hash of the decision before: ``(subject, seq)``."""
    digest = F.sha2(F.concat_ws("\x00", F.col("subject"), F.col("seq").cast("string"), F.col("decision"), F.col("reviewer")), 256)
    return chain_breaks(reviews.select(F.col("subject").alias("chain"), "seq", digest.alias("digest"), "previous")).select(F.col("chain").alias("subject"), "seq")


def classify_failure(status: Column) -> Column:
    """What a failed call's HTTP status asks for: again, later, or no more."""
    return F.when(status == 429, "rate-limited").when((status == 408) | (status >= 500), "retryable").when(status.isin(401, 403), "credentials").otherwise("permanent")


def _ev(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


def _lineage(s: SparkSession, d: str) -> DataFrame:
    n, c, o = (table(s, d, t) for t in ("nation", "customer", "orders"))
    edge = lambda df, p, pk, c, ck: df.select(F.concat(F.lit(p), F.col(pk).cast("string")).alias("parent"), F.concat(F.lit(c), F.col(ck).cast("string")).alias("child"))
    edges = edge(n, "region-", "n_regionkey", "nation-", "n_nationkey").unionByName(edge(c, "nation-", "c_nationkey", "customer-", "c_custkey")).unionByName(edge(o.filter("o_orderstatus <> 'P'"), "customer-", "o_custkey", "order-", "o_orderkey"))
    return deletion_plan(edges, s.createDataFrame([("region-1",)], "id string"))


def _chain(s: SparkSession, d: str) -> DataFrame:
    digest = F.sha2(F.concat_ws(":", F.col("event_id").cast("string"), "event_type"), 256)
    e = _ev(s, d).select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"), digest.alias("digest"), "event_type")
    prior = F.coalesce(F.lag("digest").over(Window.partitionBy("chain").orderBy("seq")), F.lit(""))
    return chain_breaks(e.withColumn("previous", F.when(F.col("event_type") == "purchase", "x").otherwise(prior)).select("chain", "seq", "digest", "previous"))


def _submit(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return submit_within(o.select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("request"), F.col("o_totalprice").alias("estimate")), 600000.0).select("batch", "seq", "outcome")


def _dispatch(s: SparkSession, d: str) -> DataFrame:
    e = _ev(s, d)
    return dispatch(e.select(F.col("user_id").alias("fleet"), F.col("event_id").alias("seq"), F.col("event_id").alias("task"), F.when(F.col("event_type") == "click", "queued").otherwise("running").alias("state"), F.when(F.col("value") > 50, "w").alias("owner")))


def _orphans(s: SparkSession, d: str) -> DataFrame:
    return orphans(table(s, d, "customer").select(F.col("c_custkey").alias("id")), table(s, d, "orders").select(F.col("o_custkey").alias("id")))


_PRICES = [("click", 1.0, 2.0), ("view", 0.5, 1.0), ("purchase", 3.0, 6.0)]
QUERIES = {
    "batch_submit": _submit, "fleet_dispatch": _dispatch, "fleet_orphans": _orphans,
    "budget_running_total": lambda s, d: running_budget(table(s, d, "orders").select(F.col("o_custkey").alias("stage"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("cost")), 500000.0).select("stage", "seq", F.round("spent", 2).alias("spent"), "ok"),
    "provider_cost_rollup": lambda s, d: cost_rollup(_ev(s, d).select(F.col("event_type").alias("role"), F.col("event_type").alias("model"), F.floor("value").alias("input_tokens"), F.col("event_id").alias("output_tokens")), s.createDataFrame(_PRICES, "model string, input_price double, output_price double")),
    "rate_window_usage": lambda s, d: rate_windows(_ev(s, d), "60 seconds", 1),
    "paid_call_dedupe": lambda s, d: first_success(_ev(s, d).select(F.col("props").alias("identity"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))),
    "batch_reconcile": lambda s, d: reconcile_batches(table(s, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_totalprice").alias("estimate")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("seq"), F.col("l_extendedprice").alias("cost"))),
    "attempt_recovery": lambda s, d: recover_attempts(_ev(s, d).select(F.col("user_id").alias("record"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == "click", "running").otherwise("succeeded").alias("status"), F.col("ts").alias("lease")), F.lit("2024-01-15").cast("timestamp_ntz")),
    "event_sequence_gaps": lambda s, d: sequence_gaps(_ev(s, d).select(F.col("user_id").alias("run"), F.floor("value").cast("long").alias("sequence"), F.col("event_id").alias("arrival")), 0),
    "remote_job_states": lambda s, d: remote_jobs(_ev(s, d).select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")).alias("type"))),
    "state_transitions": lambda s, d: illegal_transitions(_ev(s, d).select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("state")), s.createDataFrame([("click", "view"), ("view", "click"), ("view", "purchase")], "from_state string, to_state string")),
    "capacity_ranking": lambda s, d: rank_capacity(table(s, d, "supplier").select(F.col("s_name").alias("name"), F.pmod("s_suppkey", F.lit(96)).alias("vram"), F.col("s_nationkey").cast("string").alias("data_center"), F.col("s_acctbal").alias("hourly"), F.pmod("s_suppkey", F.lit(3)).alias("available")), "7", 24),
    "checkpoint_recovery": lambda s, d: recover_checkpoint(_ev(s, d).select(F.col("user_id").alias("run"), F.col("event_id").cast("string").alias("path"), F.col("event_id").alias("step"), (F.col("event_type") != "click").alias("complete"), (F.col("value") > 20).alias("intact"))),
    "cost_reconciliation": lambda s, d: reconcile_costs(table(s, d, "orders").select(F.col("o_orderkey").alias("run"), F.lit(2.5).alias("hourly"), F.col("o_totalprice").alias("seconds"), F.col("o_orderdate").alias("observed_at"), F.col("o_totalprice").alias("billed"), F.when(F.col("o_orderstatus") != "P", F.lit("1995-06-01").cast("timestamp_ntz")).alias("billed_through"))),
    "lineage_deletion": _lineage,
    "evidence_chain_check": _chain,
    "quota_deficits": lambda s, d: quota_deficits(table(s, d, "documents").select(F.array_compact(F.array("doc_kind", "domain_name", "source")).alias("labels")), table(s, d, "mix_targets").select(F.col("source_name").alias("label"), F.round(F.col("target_share") * 2000).cast("long").alias("target"))),
    "judge_scores": lambda s, d: judge_scores(table(s, d, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_linenumber").alias("ordering"), (F.col("l_quantity") / 50).alias("d1"), (F.col("l_discount") * 12).alias("d2"), (F.col("l_tax") * 10).alias("d3"), F.lit(None).cast("double").alias("d4"), (F.col("l_quantity") / 40).alias("quality"))),
    "retry_delays": lambda s, d: _ev(s, d).select("event_id", retry_delay(F.pmod("event_id", F.lit(6)).cast("double"), F.pmod("user_id", F.lit(4)) / 4, F.floor("value") * 10).alias("delay_ms")),
}
_CL = "greatest(0.0, least(1.0, coalesce({}, 0.0)))::DOUBLE"
SQL = {
    "batch_submit": "WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1 AS f FROM orders), s AS (SELECT *, sum(CASE WHEN f THEN o_totalprice ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT o_custkey AS batch, o_orderkey AS seq, CASE WHEN NOT f THEN 'duplicate' WHEN s > 600000 THEN 'over-budget' ELSE 'submitted' END AS outcome FROM s",
    "fleet_dispatch": "SELECT user_id AS fleet, min(event_id) AS task, count(*) AS waiting, count(*) FILTER (WHERE value > 50) AS owned FROM events WHERE event_type = 'click' GROUP BY 1",
    "fleet_orphans": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "budget_running_total": "WITH x AS (SELECT o_custkey AS stage, o_orderkey AS seq, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders) SELECT stage, seq, round(s, 2) AS spent, s <= 500000.0 AS ok FROM x",
    "provider_cost_rollup": "WITH p(model, i, o) AS (VALUES ('click', 1.0, 2.0), ('view', 0.5, 1.0), ('purchase', 3.0, 6.0)) SELECT event_type AS role, sum(floor(value)::BIGINT)::BIGINT AS input_tokens, sum(event_id)::BIGINT AS output_tokens, round(sum(coalesce((floor(value) * i::DOUBLE + event_id * o::DOUBLE) / 1e6, 0)), 6) AS cost, count(*) FILTER (WHERE i IS NULL) AS unpriced FROM events LEFT JOIN p ON model = event_type GROUP BY 1",
    "rate_window_usage": "SELECT time_bucket(INTERVAL '60 seconds', ts) AS start, count(*) AS calls, greatest(count(*) - 1, 0) AS over FROM events GROUP BY 1",
    "paid_call_dedupe": "SELECT props AS identity, min(event_id) AS seq, count(*) AS paid FROM events WHERE event_type <> 'error' GROUP BY 1",
    "batch_reconcile": "WITH f AS (SELECT l_orderkey AS r, arg_min(l_extendedprice, (l_linenumber, l_partkey, l_extendedprice)) AS cost FROM lineitem GROUP BY 1) SELECT count(*) AS submitted, count(cost) AS completed, count(*) FILTER (WHERE cost IS NULL) AS pending, round(sum(cost), 3) AS cost FROM orders LEFT JOIN f ON r = o_orderkey",
    "attempt_recovery": "WITH a AS (SELECT user_id AS record, event_id, CASE WHEN event_type = 'click' THEN CASE WHEN ts <= TIMESTAMP '2024-01-15' THEN 'failed_retryable' ELSE 'running' END ELSE 'succeeded' END AS s FROM events) SELECT record, arg_max(s, event_id) AS status, count(*) AS attempts, count(*) + 1 AS next_attempt FROM a GROUP BY 1",
    "event_sequence_gaps": "WITH x AS (SELECT user_id AS run, floor(value)::BIGINT AS sequence, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS expected FROM events) SELECT * FROM x WHERE sequence <> expected",
    "remote_job_states": "SELECT user_id AS job, arg_max(CASE WHEN event_type = 'click' THEN 'running' ELSE event_type END, event_id) AS status, count(*) FILTER (WHERE event_type = 'click') AS attempts, count(*) AS events FROM events GROUP BY 1",
    "state_transitions": "WITH x AS (SELECT user_id AS job, event_id AS seq, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state, event_type AS to_state FROM events) SELECT * FROM x WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (('click', 'view'), ('view', 'click'), ('view', 'purchase'))",
    "capacity_ranking": "WITH x AS (SELECT s_name AS name, s_acctbal AS hourly, array_to_string(list_filter([CASE WHEN s_suppkey % 3 < 1 THEN 'capacity' END, CASE WHEN s_nationkey <> 7 THEN 'volume-locality' END, CASE WHEN s_suppkey % 96 < 24 THEN 'vram' END], lambda r: r IS NOT NULL), ',') AS reasons FROM supplier) SELECT name, reasons = '' AS compatible, reasons, row_number() OVER (ORDER BY reasons = '' DESC, hourly, name)::INTEGER AS rank FROM x",
    "checkpoint_recovery": "WITH x AS (SELECT user_id AS run, event_id AS step, event_type <> 'click' AND value > 20 AS good FROM events), b AS (SELECT run, max(step) FILTER (WHERE good) AS step FROM x GROUP BY 1) SELECT b.run, b.step::VARCHAR AS path, b.step, count(*) FILTER (WHERE x.step > coalesce(b.step, -1)) AS fallbacks FROM x JOIN b USING (run) GROUP BY b.run, b.step",
    "cost_reconciliation": "SELECT o_orderkey AS run, round(2.5::DOUBLE * o_totalprice / 3600, 7) AS observed, o_totalprice AS billed, o_orderstatus = 'P' OR TIMESTAMP '1995-06-01' < o_orderdate AS lagging FROM orders",
    "lineage_deletion": "WITH RECURSIVE e AS (SELECT 'region-' || n_regionkey AS p, 'nation-' || n_nationkey AS c FROM nation UNION ALL SELECT 'nation-' || c_nationkey, 'customer-' || c_custkey FROM customer UNION ALL SELECT 'customer-' || o_custkey, 'order-' || o_orderkey FROM orders WHERE o_orderstatus <> 'P'), d AS (SELECT 'region-1' AS id UNION SELECT c FROM e JOIN d ON p = id) SELECT id FROM d",
    "evidence_chain_check": "SELECT user_id AS chain, event_id AS seq FROM events WHERE event_type = 'purchase'",
    "quota_deficits": "WITH h AS (SELECT label, count(*) AS n FROM (SELECT unnest(list_distinct([doc_kind, domain_name, source])) AS label FROM documents) WHERE label IS NOT NULL GROUP BY 1), r AS (SELECT source_name AS label, round(target_share * 2000)::BIGINT AS target FROM mix_targets) SELECT label, target, coalesce(n, 0)::BIGINT AS available, greatest(0, target - coalesce(n, 0))::BIGINT AS deficit FROM r LEFT JOIN h USING (label)",
    "judge_scores": f"SELECT l_orderkey AS candidate, round(avg({_CL.format('l_quantity / 50')}), 9) AS d1, round(avg({_CL.format('l_discount * 12')}), 9) AS d2, round(avg({_CL.format('l_tax * 10')}), 9) AS d3, 0.0::DOUBLE AS d4, round(max({_CL.format('l_quantity / 40')}) - min({_CL.format('l_quantity / 40')}), 9) AS disagreement FROM lineitem GROUP BY 1",
    "retry_delays": "SELECT event_id, greatest((floor(value) * 10)::DOUBLE, round(100 * 2.0::DOUBLE ** (event_id % 6) * (1 + (user_id % 4) / 4))) AS delay_ms FROM events",
}
