"""Distillation pipelines: responses to prompts, and teacher scores, rankings and vectors for embedding records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import jaccard, salted, sensitive, trim_all, word_set
from corvane.operators.chat import message_text
from corvane.operators.dedupe import exact_overlap, first_similar, salted_split
from corvane.plans.stages import Stage
from corvane.session import table

# Of each kind the roles of its queries, its documents and its positives.
ROLES = {
    "query-document": ("query", "document", "document"), "retrieval-set": ("query", "positives negatives", "positives"), "triplet": ("anchor", "positive negative", "positive"),
    "teacher-score": ("query", "document", ""), "teacher-ranking": ("query", "", ""),
}


def role_texts(texts: DataFrame) -> DataFrame:
    """``texts(kind, text_role, ...)`` with ``is_query``, ``is_document`` and ``is_positive``, as its kind has its roles."""
    hit = lambda i: F.coalesce(*(F.when(F.col("kind") == k, F.col("text_role").isin(*r[i].split())) for k, r in ROLES.items() if r[i]), F.lit(False))
    return texts.withColumn("is_query", hit(0)).withColumn("is_document", hit(1)).withColumn("is_positive", hit(2))


def taxonomy(metadata: Column) -> Column:
    """Labels in ``metadata.taxonomy``: an array's strings, or one string."""
    v = F.try_variant_get(F.try_parse_json(metadata), "$.taxonomy", "variant")
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.array(v.try_cast("string"))), v.try_cast("array<string>"), F.array().cast("array<string>"))


def locked(split: Column, metadata: Column) -> Column:
    """Held out: of a split other than train, or marked so in metadata."""
    return (F.coalesce(split, F.lit("train")) != "train") | F.coalesce(F.try_variant_get(F.try_parse_json(metadata), "$.locked", "boolean"), F.lit(False))


def union_last(first: DataFrame, *others: DataFrame, key: str = "id") -> DataFrame:
    """Rows of several tables, one a key: the value of its last row in the place of its first; ``position`` orders tables, then ``pos``."""
    every = None
    for i, t in enumerate((first, *others)):
        t = t.withColumn("_at", F.struct(F.lit(i).alias("table"), "pos"))
        every = t if every is None else every.unionByName(t)
    cols = [c for c in first.columns if c not in (key, "pos")]
    got = every.groupBy(key).agg(F.max_by(F.struct(*cols), "_at").alias("v"), F.min("_at").alias("position"))
    return got.select(key, "v.*", "position")


def decision_id(*parts: Column) -> Column:
    """Hash of a decision's parts."""
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256)


def decisions(candidates: DataFrame, salt: str, judged: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``candidates(record, candidate, messages)`` to their decisions ``(record, candidate, stage, outcome, reason, id)``.

    validate: the last message is the assistant's. policy: nothing sensitive, else for review. verify:
    the answer is not blank. judge: ``judged(candidate, quality)`` reaches the threshold; NaN does not.
    filter: none of these rejected it.
    """
    last = F.element_at("messages", -1)
    d = candidates.select("record", "candidate", last["role"].alias("role"), message_text(last).alias("body"), F.array_join(F.transform("messages", message_text), "\n").alias("all"))
    found = F.transform(sensitive(F.col("all")), lambda x: x["kind"])
    quality = F.lit(None).cast("double")
    if judged is not None:
        d = d.join(judged.select("candidate", F.col("quality").alias("_q")), "candidate", "left")
        quality = F.col("_q")
    good = F.coalesce(~F.isnan(quality) & (quality >= threshold), F.lit(False))
    one = lambda stage, ok, no, why: F.struct(F.lit(stage).alias("stage"), F.when(ok, "accepted").otherwise(no).alias("outcome"), why.alias("reason"))
    stages = [
        one("validate", F.coalesce(F.col("role") == "assistant", F.lit(False)), "rejected", F.lit("assistant target required")),
        one("policy", F.size(found) == 0, "review", F.when(F.size(found) > 0, F.concat(F.lit("sensitive: "), F.array_join(found, ","))).otherwise("clean")),
        one("verify", trim_all(F.col("body")) != "", "rejected", F.when(trim_all(F.col("body")) != "", "nonempty").otherwise("empty response")),
        *([one("judge", good, "rejected", F.concat(F.lit("quality="), F.coalesce(quality.cast("string"), F.lit("none"))))] if judged is not None else []),
    ]
    d = d.withColumn("s", F.array(*stages))
    bad = F.exists("s", lambda x: x["outcome"] == "rejected")
    d = d.withColumn("s", F.concat("s", F.array(F.struct(F.lit("filter").alias("stage"), F.when(bad, "rejected").otherwise("accepted").alias("outcome"), F.when(bad, "upstream rejection").otherwise("passed").alias("reason")))))
    e = d.select("record", "candidate", F.posexplode("s").alias("seq", "x")).select("record", "candidate", F.col("x.stage").alias("stage"), F.col("x.outcome").alias("outcome"), F.col("x.reason").alias("reason"))
    return e.withColumn("id", decision_id(F.lit(salt), F.col("candidate"), F.col("stage"), F.col("outcome")))


def chat_pipeline(generate: Callable[[DataFrame], DataFrame], salt: str, judge: Callable[[DataFrame], DataFrame] | None = None, minhash_threshold: float = 0.8, ratios: tuple[float, float] = (0.8, 0.1)) -> list[Stage]:
    """Stages of response distillation over ``examples(record, messages, split, group_id, metadata, provenance)``, for ``plans.stages.run``.

    ``generate(prompts)`` gives ``(record, candidate, messages)``; ``judge(candidates)`` gives ``(candidate,
    quality)``. Held-out records are not sent to it. ``groups`` has leakage group, bucket and split,
    ``dedupe`` each candidate's least similar prior one, ``contamination`` the train rows of equal body,
    ``final`` one row a record: its first accepted candidate, if the record is not held out and its last
    candidate repeats no other. Stage tables make a lost run resume where it stood.
    """

    def groups(x: DataFrame) -> DataFrame:
        g = x.select("record", salted(salt, F.coalesce("group_id", "provenance.sourceId", "record")).alias("leakage_group"), F.coalesce(F.get(taxonomy(F.col("metadata")), 0), F.lit("uncategorized")).alias("bucket"), locked(F.col("split"), F.col("metadata")).alias("locked"), "split")
        held = g.filter("locked").groupBy("leakage_group").agg(F.min_by("split", "record").alias("held"))
        return g.join(held, "leakage_group", "left").withColumn("assigned", F.coalesce("held", salted_split(F.col("leakage_group"), salt, *ratios)))

    def bodies(c: DataFrame) -> DataFrame:
        return c.select(F.struct("record", "candidate").alias("key"), F.lower(message_text(F.element_at("messages", -1))).alias("body"))

    def final(x: DataFrame, g: DataFrame, c: DataFrame, dec: DataFrame, dup: DataFrame) -> DataFrame:
        ok = dec.filter("stage = 'filter' AND outcome = 'accepted'").select("record", "candidate")
        first = ok.groupBy("record").agg(F.min("candidate").alias("candidate"))
        lastly = dup.select("key.record", "key.candidate", F.col("kind")).groupBy("record").agg(F.max_by("kind", "candidate").alias("kind"))
        return first.join(c, ["record", "candidate"]).join(g.filter("NOT locked"), "record").join(lastly.filter("kind = 'representative'").select("record"), "record", "left_semi").select("record", "candidate", "messages", F.col("assigned").alias("split"), "leakage_group")

    def overlap(g: DataFrame, c: DataFrame) -> DataFrame:
        rows = bodies(c).join(g.select("record", "assigned"), F.col("key.record") == F.col("record")).select("key", "body", F.col("assigned").alias("split"))
        return exact_overlap(rows)

    return [
        Stage("ingest", lambda x: x, ("examples",)), Stage("groups", groups, ("ingest",)),
        Stage("responses", lambda x, g: generate(x.join(g.filter("NOT locked").select("record"), "record", "left_semi")), ("ingest", "groups")),
        *([Stage("judged", judge, ("responses",))] if judge else []),
        Stage("decisions", lambda c, *j: decisions(c, salt, *j), ("responses", *(("judged",) if judge else ()))), Stage("dedupe", lambda c: first_similar(bodies(c), minhash_threshold), ("responses",)),
        Stage("contamination", overlap, ("groups", "responses")), Stage("final", final, ("ingest", "groups", "responses", "decisions", "dedupe")),
    ]


def plan_counts(examples: DataFrame) -> DataFrame:
    """What a run would do: ``(stage, rows)`` of records, held-out ones, those to generate for, and candidates to judge in both orders."""
    held = F.count_if(locked(F.col("split"), F.col("metadata")))
    n = F.count(F.lit(1))
    a = examples.agg(n.alias("ingest"), held.alias("locked"), (n - held).alias("responses"), (2 * (n - held)).alias("judge"))
    return a.select(F.explode(F.create_map(*(x for c in ("ingest", "locked", "responses", "judge") for x in (F.lit(c), F.col(c))))).alias("stage", "rows"))


def mining_outcomes(queries: DataFrame, mined: DataFrame, documents: DataFrame, near: float = 0.9, limit: int | None = None) -> DataFrame:
    """``mined(query_id, document, rank)`` with why each is left out, or ``kept``: the pool a query's teacher scores.

    ``queries(query_id, text, group, positives array)``, ``documents(document, text, group)``. Reasons in
    order: ``positive``, ``same-group`` (the document is in a record of the query's split group),
    ``near-duplicate`` of the query by words. ``limit`` keeps each query's best by rank before.
    """
    m = mined
    if limit is not None:
        m = m.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "document"))).filter(F.col("_r") <= limit).drop("_r")
    groups = documents.select("document", "group").distinct().withColumn("same", F.lit(True))
    body = documents.groupBy("document").agg(F.min("text").alias("doc_text"))
    j = m.join(queries, "query_id").join(body, "document").join(groups, ["document", "group"], "left")
    why = F.when(F.array_contains("positives", F.col("document")), "positive").when(F.col("same"), "same-group").when(jaccard(word_set(F.col("text")), word_set(F.col("doc_text"))) >= near, "near-duplicate")
    return j.select("query_id", "document", F.coalesce(why, F.lit("kept")).alias("outcome"))


def pool_errors(pools: DataFrame, ranked: DataFrame) -> DataFrame:
    """``EMBED_RANKING_POOL`` for queries whose ``ranked(query_id, ranking array)`` is not just the kept candidates of ``pools(query_id, document, outcome)``, each once."""
    kept = pools.filter("outcome = 'kept'").groupBy("query_id").agg(F.array_sort(F.collect_set("document")).alias("pool"))  # a query's candidates, at most its mining limit
    j = kept.join(ranked, "query_id", "full")
    ok = F.coalesce(F.array_sort("ranking") == F.col("pool"), F.lit(False))
    return j.filter(~ok).select("query_id", F.lit("EMBED_RANKING_POOL").alias("code"))


def score_errors(scores: DataFrame) -> DataFrame:
    """``EMBED_SCORE_CALIBRATION`` for queries with a ``scores(query_id, document, score, low, high)`` that is no number in its scale."""
    s = F.col("score")
    bad = s.isNull() | F.isnan(s) | ~s.between(F.col("low"), F.col("high"))
    return scores.filter(bad).select("query_id", F.lit("EMBED_SCORE_CALIBRATION").alias("code")).distinct()


def teacher_rows(pools: DataFrame, scores: DataFrame, judged: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(kind, query_id, document, score, ranking, record_id)``: a score row for each kept and accepted pair, a ranking row for each query."""
    kept = pools.filter("outcome = 'kept'").select("query_id", "document")
    s = kept.join(scores, ["query_id", "document"]).join(judged.filter("accepted").select("query_id", "document"), ["query_id", "document"], "left_semi")
    s = s.select(F.lit("teacher-score").alias("kind"), "query_id", "document", "score", F.lit(None).cast("array<string>").alias("ranking"))
    r = ranked.join(kept.select("query_id").distinct(), "query_id", "left_semi").select(F.lit("teacher-ranking").alias("kind"), "query_id", F.lit(None).cast("string").alias("document"), F.lit(None).cast("double").alias("score"), "ranking")
    return s.unionByName(r).withColumn("record_id", F.sha2(F.concat_ws("\x00", "kind", "query_id", "document"), 256))


def embedding_pipeline(services: dict[str, Callable[..., DataFrame]], near: float = 0.9, limit: int = 100) -> list[Stage]:
    """Stages of embedding distillation over ``texts(record_id, kind, split, group, text_role, id, text)``, for ``plans.stages.run``.

    ``services``: ``generate(documents)`` gives ``(id, text, group, source_document)``, ``verify(generated)`` adds
    ``supported``, ``mine(queries, documents)`` gives ``(query_id, document, rank)``, ``score(pool)`` gives
    ``(query_id, document, score, low, high)``, ``judge(scores)`` adds ``accepted``, ``rank(pool)`` gives
    ``(query_id, ranking)`` and ``embed(texts)`` gives ``(id, vector)``. Only train records take part.
    """
    s = services

    def corpus(t: DataFrame) -> DataFrame:
        return role_texts(t.filter("split = 'train'")).select(F.col("id"), "text", "group", "record_id", "is_query", "is_document", "is_positive")

    def queries(c: DataFrame, v: DataFrame) -> DataFrame:
        positives = c.filter("is_positive").select("record_id", F.col("id").alias("p"))
        own = c.filter("is_query").join(positives, "record_id", "left").groupBy(F.col("id").alias("query_id"), "text", "group").agg(F.collect_set("p").alias("positives"))
        made = v.filter("supported").select(F.col("id").alias("query_id"), "text", "group", F.array().cast("array<string>").alias("positives"))
        return own.unionByName(made).dropDuplicates(["query_id", "group"])

    def documents(c: DataFrame) -> DataFrame:
        return c.filter("is_document").select(F.col("id").alias("document"), "text", "group").distinct()

    def pool(q: DataFrame, m: DataFrame, d: DataFrame) -> DataFrame:
        return mining_outcomes(q, m, d, near, limit)

    def rows(p: DataFrame, sc: DataFrame, j: DataFrame, r: DataFrame) -> DataFrame:
        broken = pool_errors(p, r).unionByName(score_errors(sc))
        checked = teacher_rows(p, sc, j, r).join(broken.groupBy("query_id").agg(F.first("code").alias("code")), "query_id", "left")
        return checked.withColumn("query_id", F.when(F.col("code").isNull(), F.col("query_id")).otherwise(F.raise_error(F.col("code")).cast("string"))).drop("code")

    def vectors(c: DataFrame, v: DataFrame) -> DataFrame:
        every = union_last(c.select("id", "text", F.lit(0).alias("pos")), v.filter("supported").select("id", "text", F.lit(0).alias("pos")))
        return s["embed"](every.select("id", "text"))

    return [
        Stage("corpus", corpus, ("texts",)), Stage("documents", documents, ("corpus",)), Stage("generated", s["generate"], ("documents",)), Stage("verified", s["verify"], ("generated",)), Stage("queries", queries, ("corpus", "verified")),
        Stage("mined", s["mine"], ("queries", "documents")), Stage("pool", pool, ("queries", "mined", "documents")), Stage("scores", s["score"], ("pool",)), Stage("judged", s["judge"], ("scores",)), Stage("ranked", s["rank"], ("pool",)),
        Stage("rows", rows, ("pool", "scores", "judged", "ranked")), Stage("vectors", vectors, ("corpus", "verified")),
    ]


def _chat(s: SparkSession, d: str) -> DataFrame:
    latest = table(s, d, "chat_examples").groupBy(F.col("example_id").alias("record")).agg(F.max_by(F.struct("messages", "split", "metadata"), "ingested_at").alias("x"))
    return latest.select("record", "x.*")


def _decision_counts(s: SparkSession, d: str) -> DataFrame:
    return decisions(_chat(s, d).select("record", F.col("record").alias("candidate"), "messages"), "s").groupBy("stage", "outcome").agg(F.count(F.lit(1)).alias("candidates"))


def _roles(s: SparkSession, d: str) -> DataFrame:
    kinds = table(s, d, "embedding_records").groupBy("record_id").agg(F.max_by("kind", "ingested_at").alias("kind"))
    t = role_texts(table(s, d, "embedding_texts").join(kinds, "record_id"))
    return t.groupBy("kind").agg(*(F.count_if(F.col(c)).alias(c) for c in ("is_query", "is_document", "is_positive")))


def _last(s: SparkSession, d: str) -> DataFrame:
    t = lambda lo: table(s, d, "embedding_records").filter(F.col("split") == lo).select(F.col("split_group").alias("id"), "record_id", F.col("ingested_at").cast("string").alias("pos_time"), F.struct("ingested_at", "record_id").alias("pos")).filter("id <> ''")
    return union_last(t("train"), t("test")).select("id", "record_id")


QUERIES = {
    "distill_decisions": _decision_counts, "distill_plan_counts": lambda s, d: plan_counts(_chat(s, d)), "role_texts": _roles, "union_last_value": _last,
    "candidate_count": lambda s, d: _chat(s, d).agg(F.sum(F.size(F.filter("messages", lambda m: m["role"] == "assistant"))).cast("long").alias("candidates")),
}

_LATEST = "l AS (SELECT * FROM chat_examples QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY ingested_at DESC) = 1)"
_TEXT = "coalesce(array_to_string(list_transform(list_filter({}.content, lambda p: p.type = 'text'), lambda p: coalesce(p.text, '')), chr(10)), '')"


def _sql() -> dict[str, str]:
    from corvane.operators.records import _EM, _PH, _SE

    roles = {k: [" ".join(f"'{x}'" for x in r.split()).replace(" ", ", ") or "''" for r in v] for k, v in ROLES.items()}
    counts = [f"count(*) FILTER (WHERE {' OR '.join(f'kind = {chr(39)}{k}{chr(39)} AND text_role IN ({v[i]})' for k, v in roles.items())}) AS {c}" for i, c in enumerate(("is_query", "is_document", "is_positive"))]
    return {
        "distill_decisions": f"""WITH {_LATEST}, b AS (SELECT messages[-1].role = 'assistant' AS a, {_TEXT.format("messages[-1]")} AS body, array_to_string(list_transform(messages, lambda m: {_TEXT.format("m")}), chr(10)) AS t FROM l),
c AS (SELECT coalesce(a, false) AS a, regexp_matches(t, '{_EM}') OR regexp_matches(t, '{_PH}') OR regexp_matches(t, '{_SE}') AS s, trim(regexp_replace(body, '\\s+', ' ', 'g')) <> '' AS v FROM b),
o AS (SELECT unnest([{{'stage': 'validate', 'outcome': CASE WHEN a THEN 'accepted' ELSE 'rejected' END}}, {{'stage': 'policy', 'outcome': CASE WHEN s THEN 'review' ELSE 'accepted' END}}, {{'stage': 'verify', 'outcome': CASE WHEN v THEN 'accepted' ELSE 'rejected' END}}, {{'stage': 'filter', 'outcome': CASE WHEN a AND v THEN 'accepted' ELSE 'rejected' END}}]) AS x FROM c)
SELECT x.stage AS stage, x.outcome AS outcome, count(*) AS candidates FROM o GROUP BY ALL""",
        "distill_plan_counts": f"""WITH {_LATEST}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(split, 'train') <> 'train' OR coalesce(CASE WHEN json_valid(metadata) THEN metadata->>'$.locked' END = 'true', false)) AS h FROM l)
SELECT 'ingest' AS stage, n AS rows FROM n UNION ALL SELECT 'locked', h FROM n UNION ALL SELECT 'responses', n - h FROM n UNION ALL SELECT 'judge', 2 * (n - h) FROM n""",
        "role_texts": f"WITH l AS (SELECT record_id, arg_max(kind, ingested_at) AS kind FROM embedding_records GROUP BY 1) SELECT kind, {', '.join(counts)} FROM embedding_texts JOIN l USING (record_id) GROUP BY 1",
        "union_last_value": "SELECT split_group AS id, arg_max(record_id, (split = 'test', ingested_at, record_id)) AS record_id FROM embedding_records WHERE split IN ('train', 'test') AND split_group <> '' GROUP BY 1",
        "candidate_count": f"WITH {_LATEST} SELECT sum(len(list_filter(messages, lambda m: m.role = 'assistant')))::BIGINT AS candidates FROM l",
    }


SQL = _sql()
