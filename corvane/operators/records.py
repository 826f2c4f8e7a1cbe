"""Embedding records: decoding, encoding, validation, inspection, mining, governed logs, distilled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import jaccard, salted, sensitive, text_hash, trim_all, word_set
from corvane.operators.dedupe import salted_split
from corvane.session import table

# Columns a decoder knows; all others are kept as metadata.
KNOWN = (
    "anchor query positive document negative positives negatives left right text1 text2 score label labels text instruction vector teacher candidates ranking candidate_pool_id corpus_id id split_group"
).split()

# Columns whose equal values relate records, of records and of their texts.
RECORD_KEYS = ("split_group", "parent_group", "translation_group", "synthetic_group", "source_id")
TEXT_KEYS = ("entity_id", "document_id", "corpus_id")


def detect_task(keys: Column) -> Column:
    """Task of an external row by its column names; ``error:...`` where they fit several or none."""

    def has(*k: str) -> Column:
        return F.forall(F.array(*map(F.lit, k)), lambda x: F.array_contains(keys, x))

    two = has("left", "right") | has("text1", "text2")
    return (
        F.when(has("anchor", "positive", "negative") | has("query", "positive", "negative"), "triplet")
        .when(has("query", "positives"), "retrieval-set").when(has("text", "vector", "teacher"), "teacher-vector")
        .when(has("query", "candidates", "ranking", "teacher", "candidate_pool_id", "corpus_id"), "teacher-ranking")
        .when((has("anchor", "positive") | has("query", "document")) & ~has("score", "label"), "pair")
        .when(has("text", "label") | ((two | has("query", "document")) & has("score")) | (two & has("label")), "error:EMBED_AMBIGUOUS_COLUMNS")
        .otherwise("error:EMBED_TASK_MAPPING_REQUIRED")
    )


def decode_rows(rows: DataFrame, group_column: str = "split_group") -> DataFrame:
    """JSON rows ``(key, payload)`` to ``(key, task, group, query, document, negative, extra, error)`` for pairs and triplets.

    Text of every role the task has is required and not blank (``negative``: triplets alone); rows of
    the other kinds give an error code (see the README); the group is required; unknown columns stay as
    JSON in ``extra``. Broken JSON and each missing part give an error code instead of a value.
    """
    f = F.from_json("payload", "map<string,string>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    d = rows.withColumn("f", F.when(F.try_parse_json("payload").isNotNull(), f)).withColumn("task", detect_task(F.map_keys("f")))
    get = lambda *k: F.coalesce(*(F.try_element_at("f", F.lit(x)) for x in k))
    query, doc, group = get("query", "anchor"), get("document", "positive"), get(group_column)
    triplet, negative = F.col("task") == "triplet", get("negative")
    doc = F.when(triplet, get("positive", "document")).otherwise(doc)
    query = F.when(triplet, get("anchor", "query")).otherwise(query)
    blank = lambda c: trim_all(F.coalesce(c, F.lit(""))) == ""
    error = (
        F.when(F.col("f").isNull(), "EMBED_JSON").when(F.col("task").startswith("error:"), F.substring("task", 7, 100)).when(F.coalesce(group, F.lit("")) == "", "EMBED_GROUPS_MISSING")
        .when(blank(query) | blank(doc) | (triplet & blank(negative)), "EMBED_TEXT_REQUIRED")
    )
    extra = F.map_filter("f", lambda k, _: ~k.isin(*KNOWN, group_column))
    ok = error.isNull()
    return d.select("key", F.when(ok, F.col("task")).alias("task"), F.when(ok, group).alias("group"), F.when(ok, query).alias("query"), F.when(ok, doc).alias("document"), F.when(ok & triplet, negative).alias("negative"), F.when(ok & (F.size(extra) > 0), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(extra))))).alias("extra"), error.alias("error"))


def encode_pairs(pairs: DataFrame, form: str) -> DataFrame:
    """Pairs ``(query, document)`` as JSON rows: ``sentence-transformers`` (anchor, positive) or ``hf`` (query, document)."""
    names = {"sentence-transformers": ("anchor", "positive"), "hf": ("query", "document")}[form]
    return pairs.select(F.to_json(F.struct(F.col("query").alias(names[0]), F.col("document").alias(names[1]))).alias("value"))


def record_issues(records: DataFrame, texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """First failing rule of each record: ``(record_id, code)``.

    Provenance, blank text, stale text hash, score scale, vector shape and L2 norm, in that order.
    """
    t = texts.groupBy("record_id").agg(F.max(trim_all(F.coalesce("text", F.lit(""))) == "").alias("blank"), F.max(F.coalesce(F.col("text_hash") != text_hash(F.col("text")), F.lit(True))).alias("stale"))
    size = F.size("vec") != F.col("dimension")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    v = vectors.filter("storage_kind = 'inline' AND vec IS NOT NULL").groupBy("record_id").agg(F.max(size | ~finite).alias("shape"), F.max((F.col("norm") == "l2") & finite & (F.abs(norm - 1) > 1e-5)).alias("norm"))
    r = records.join(t, "record_id", "left").join(v, "record_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    scale = F.col("kind").isin("scored-pair", "sts", "teacher-score") & ~F.coalesce((F.col("scale_min") < F.col("scale_max")) & F.col("score").between(F.col("scale_min"), F.col("scale_max")), F.lit(False))
    code = (
        F.when(no("split_group") | no("split") | no("revision") | no("license") | no("rights"), "EMBED_PROVENANCE_REQUIRED").when(yes("blank"), "EMBED_TEXT_REQUIRED").when(yes("stale"), "EMBED_TEXT_HASH")
        .when(scale, "EMBED_SCORE_SCALE").when(yes("shape"), "EMBED_VECTOR_SHAPE").when(yes("norm"), "EMBED_VECTOR_NORM")
    )
    return r.select("record_id", code.alias("code")).filter("code IS NOT NULL")


def global_issues(records: DataFrame, texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Issues across records: ids given again, text ids with differing content, negatives that are positives, mixed dimensions."""
    again = records.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("EMBED_DUPLICATE_ID").alias("code"), F.col("record_id").alias("subject"), (F.col("n") - 1).alias("times"))
    prior = F.lag("text_hash").over(Window.partitionBy("id").orderBy("text_key"))
    changed = texts.withColumn("prior", prior).filter("prior IS NOT NULL AND text_hash IS NOT NULL AND prior <> text_hash").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    conflict = changed.select(F.lit("EMBED_GLOBAL_TEXT_ID_CONFLICT").alias("code"), F.col("id").alias("subject"), F.col("n").alias("times"))
    sides = texts.groupBy("record_id", "id").agg(F.max(F.col("text_role").isin("positive", "positives")).alias("p"), F.max(F.col("text_role").isin("negative", "negatives")).alias("q")).filter("p AND q")
    both = sides.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("EMBED_POSITIVE_NEGATIVE_CONFLICT").alias("code"), F.col("record_id").alias("subject"), F.col("n").alias("times"))
    dims = vectors.filter("dimension IS NOT NULL").agg(F.count_distinct("dimension").alias("n")).filter("n > 1").select(F.lit("EMBED_VECTOR_DIMENSION_INCONSISTENT").alias("code"), F.lit("$").alias("subject"), F.col("n").alias("times"))
    return again.unionByName(conflict).unionByName(both).unionByName(dims)


def inspect_counts(records: DataFrame) -> DataFrame:
    """Records by kind and by split, and in all, in one pass of grouping sets; groups are counted distinct."""
    g = records.groupingSets([["kind"], ["split"], []], "kind", "split").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("records"), F.count_distinct("split_group").alias("groups"))
    name = F.when(F.col("g") == 1, F.concat(F.lit("kind:"), F.coalesce("kind", F.lit("null")))).when(F.col("g") == 2, F.concat(F.lit("split:"), F.coalesce("split", F.lit("null")))).otherwise("all")
    return g.select(name.alias("slice"), "records", "groups")


def hard_negatives(queries: DataFrame, candidates: DataFrame, near: float = 0.9) -> DataFrame:
    """``queries(query_id, group, text, positive)`` with mined ``candidates(query_id, document, group, text)``: kept or why excluded.

    Reasons in order: the positive itself, a record of the same split group, a near copy of the positive by words.
    """
    j = candidates.withColumnRenamed("group", "doc_group").withColumnRenamed("text", "doc_text").join(queries.select("query_id", "group", "positive", "positive_text"), "query_id")
    why = F.when(F.col("document") == F.col("positive"), "positive").when(F.col("doc_group") == F.col("group"), "same-split-group").when(jaccard(word_set(F.col("doc_text")), word_set(F.col("positive_text"))) >= near, "near-duplicate")
    return j.select("query_id", "document", F.coalesce(why, F.lit("kept")).alias("outcome"))


def governed_logs(logs: DataFrame, redact, revision: str | None = None) -> DataFrame:
    """Redacted examples from production logs; a row that still holds sensitive text or has another revision is marked, not passed."""
    d = logs.withColumn("clean", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), redact(m["content"]).alias("text"))))
    rest = F.exists("clean", lambda m: F.size(sensitive(F.coalesce(m["text"], F.lit("")))) > 0)
    error = F.when(F.lit(False) if revision is None else F.col("revision") != revision, "LOG_SOURCE_REVISION_MISMATCH").when(rest, "LOG_REDACTION_INCOMPLETE")
    return d.select(text_hash(F.concat_ws(":", "source_name", "log_id", "revision")).alias("record_id"), "log_id", F.when(error.isNull(), F.col("clean")).alias("messages"), error.alias("error"))


def leakage_groups(examples: DataFrame, salt: str) -> DataFrame:
    """Salted hash of the group, else the source id, else the id."""
    return examples.select("example_id", salted(salt, F.coalesce("group_id", F.col("provenance.sourceId"), "example_id")).alias("leakage_group"))


def training_rows(examples: DataFrame, salt: str) -> DataFrame:
    """Distilled training rows: unlocked examples in train whose last answer was not rejected by policy, first of equal bodies."""
    from corvane.operators.chat import message_text

    d = examples.select("example_id", "split", message_text(F.element_at("messages", -1)).alias("body"), F.element_at("messages", -1)["role"].alias("role"), "group_id", "provenance")
    g = leakage_groups(examples, salt).distinct()
    d = d.join(g, "example_id").withColumn("assigned", F.when(F.col("split") != "train", F.col("split")).otherwise(salted_split(F.col("leakage_group"), salt)))
    good = d.filter((F.col("role") == "assistant") & (F.col("assigned") == "train") & (F.size(sensitive(F.col("body"))) == 0) & (trim_all(F.col("body")) != ""))
    return good.groupBy(F.lower("body").alias("body")).agg(F.min("example_id").alias("example_id"), F.count_distinct("example_id").alias("copies")).select("example_id", "copies")


def _e(s: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(s, d, f"embedding_{n}") for n in names]


def _negatives(s: SparkSession, d: str) -> DataFrame:
    er, tx = _e(s, d, "records", "texts")
    r = er.groupBy("record_id").agg(F.max_by("split_group", "ingested_at").alias("group"))
    role = lambda x: tx.filter(F.col("text_role") == x)
    q = role("anchor").select("record_id", F.col("text_key").alias("query_id"), "text").join(role("positive").select("record_id", F.col("id").alias("positive"), F.col("text").alias("positive_text")), "record_id").join(r, "record_id")
    c = role("anchor").select("record_id", F.col("text_key").alias("query_id")).join(role("negative").select("record_id", F.col("id").alias("document"), "text"), "record_id").withColumn("group", F.lit("pool"))
    return hard_negatives(q.select("query_id", "group", "positive", "positive_text"), c.select("query_id", "document", "group", "text"))


def _redact(c: Column) -> Column:
    from corvane.functions.text import EMAIL, PHONE

    return F.regexp_replace(F.regexp_replace(c, EMAIL, "[EMAIL]"), PHONE, "[PHONE]")


def _components(s: SparkSession, d: str) -> DataFrame:
    from corvane.operators.components import connected_components

    keys = F.array("split_group", "parent_group", "translation_group", "synthetic_group", "source_id")
    m = _e(s, d, "records")[0].select(F.col("record_id").alias("record"), F.explode(keys).alias("key"))
    return connected_components(m).select(F.col("record").alias("record_id"), F.col("component"))


def lineage_keys(records: DataFrame, texts: DataFrame) -> DataFrame:
    """All keys ``(record, key)`` that relate records: their own, their texts' and ``metadata.timeGroup`` where that is a string.

    Texts of no record relate nothing; a column without a value gives a null key.
    """
    group = "try_variant_get(try_parse_json(metadata), '$.timeGroup', '{}')"
    time = F.expr(f"CASE WHEN schema_of_variant({group.format('variant')}) = 'STRING' THEN {group.format('string')} END")
    own = records.select(F.col("record_id").alias("record"), F.explode(F.array(*RECORD_KEYS, time)).alias("key"))
    theirs = texts.join(records.select("record_id").distinct(), "record_id", "left_semi").select(F.col("record_id").alias("record"), F.explode(F.array_compact(F.array(*TEXT_KEYS))).alias("key"))
    return own.unionByName(theirs)


def _whole_components(s: SparkSession, d: str) -> DataFrame:
    from corvane.operators.components import connected_components

    return connected_components(lineage_keys(*_e(s, d, "records", "texts"))).select(F.col("record").alias("record_id"), "component")


def split_families(records: DataFrame, texts: DataFrame, salt: str, compat: bool = True, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Every record's family over all its keys, and its split by the salted hash of the family's root, the least key in it.

    ``(record_id, root, split)``; a record without any key is a family of its own under its id.
    """
    from corvane.operators.components import connected_components
    from corvane.operators.dedupe import family_split
    from corvane.plans.cut import cut
    from corvane.plans.skew import join_per_key

    keys = cut(lineage_keys(records, texts))
    of = cut(connected_components(keys))
    sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    roots = keys.filter(F.trim("key") != "").join(of, "record").groupBy("component").agg(F.min("key").alias("root"))
    per = sizes.join(roots, "component", "left").withColumn("root", F.coalesce("root", "component"))
    per = per.withColumn("split", family_split(F.col("root"), salt, compat, train, validation))
    return join_per_key(of, per, "component", of.count(), "n").select(F.col("record").alias("record_id"), "root", "split")


QUERIES = {
    "family_splits": lambda s, d: split_families(*_e(s, d, "records", "texts"), "s", compat=False),
    "lineage_components": _components,
    "lineage_components_whole": _whole_components,
    "import_decode": lambda s, d: decode_rows(table(s, d, "import_records").select(F.col("row_key").alias("key"), "payload"), "group").select("key", "task", "group", F.col("query"), F.length("document").alias("document_chars"), "error"),
    "record_issues": lambda s, d: record_issues(*_e(s, d, "records", "texts", "vectors")),
    "record_global_issues": lambda s, d: global_issues(*_e(s, d, "records", "texts", "vectors")),
    "inspect_counts": lambda s, d: inspect_counts(_e(s, d, "records")[0]),
    "hard_negatives": _negatives,
    "governed_logs": lambda s, d: governed_logs(table(s, d, "production_logs"), _redact).select("record_id", "log_id", F.size("messages").alias("messages"), "error"),
    "leakage_groups": lambda s, d: leakage_groups(table(s, d, "chat_examples"), "s"),
    "distill_training_rows": lambda s, d: training_rows(table(s, d, "chat_examples"), "s"),
    "provenance_manifest": lambda s, d: _e(s, d, "records")[0].agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.array_join(F.array_sort(F.collect_set("revision")), ",").alias("revisions"), F.count_distinct("split_group").alias("groups"), F.count(F.lit(1)).alias("records")),
}

_TRIM = r"regexp_replace(coalesce(text, ''), '^[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', '')"
_EM, _PH = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"\b(?:\+?[0-9][ -]?){10,14}\b"
_SE = r"(?i)\b(?:sk-[A-Za-z0-9_-]{12,}|AKIA[0-9A-Z]{16}|(?:api[_-]?key|password)\s*[:=]\s*[^\s,;]+)"
_LEAK = "sha256('s' || chr(0) || coalesce(group_id, provenance.sourceId, example_id))"
SQL = {
    "lineage_components": """WITH RECURSIVE k AS (SELECT record_id AS r, unnest([split_group, parent_group, translation_group, synthetic_group, source_id]) AS k FROM embedding_records),
p AS (SELECT DISTINCT r, k FROM k WHERE trim(coalesce(k, '')) <> ''), m AS (SELECT k, min(r) AS m FROM p GROUP BY k HAVING count(*) > 1),
e AS (SELECT DISTINCT r AS a, m AS b FROM p JOIN m USING (k) WHERE r <> m), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
x AS (SELECT a, b FROM u UNION SELECT x.a, u.b FROM x JOIN u ON x.b = u.a), c AS (SELECT a AS r, least(a, min(b)) AS c FROM x GROUP BY a)
SELECT r AS record_id, coalesce(c, r) AS component FROM (SELECT DISTINCT record_id AS r FROM embedding_records) LEFT JOIN c USING (r)""",
    "lineage_components_whole": """WITH RECURSIVE n AS (SELECT DISTINCT record_id FROM embedding_records),
k AS (SELECT record_id AS r, unnest([split_group, parent_group, translation_group, synthetic_group, source_id, CASE WHEN json_valid(metadata) AND json_type(metadata, '$.timeGroup') = 'VARCHAR' THEN metadata->>'$.timeGroup' END]) AS k FROM embedding_records
 UNION ALL SELECT record_id, unnest([entity_id, document_id, corpus_id]) FROM embedding_texts SEMI JOIN n USING (record_id)),
p AS (SELECT DISTINCT r, k FROM k WHERE trim(coalesce(k, '')) <> ''), m AS (SELECT k, min(r) AS m FROM p GROUP BY k HAVING count(*) > 1),
e AS (SELECT DISTINCT r AS a, m AS b FROM p JOIN m USING (k) WHERE r <> m), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
x AS (SELECT a, b FROM u UNION SELECT x.a, u.b FROM x JOIN u ON x.b = u.a), c AS (SELECT a AS r, least(a, min(b)) AS c FROM x GROUP BY a)
SELECT r AS record_id, coalesce(c, r) AS component FROM (SELECT record_id AS r FROM n) LEFT JOIN c USING (r)""",
    "import_decode": """WITH p AS (SELECT row_key AS key, payload, json_valid(payload) AS ok FROM import_records), f AS (SELECT key, ok, CASE WHEN ok THEN payload END AS j, CASE WHEN ok THEN payload->>'$.group' END AS g, CASE WHEN ok THEN payload->>'$.query' END AS q, CASE WHEN ok THEN payload->>'$.document' END AS d FROM p),
e AS (SELECT *, CASE WHEN NOT ok THEN 'EMBED_JSON' WHEN NOT list_has_all(json_keys(j), ['query', 'document']) THEN 'EMBED_TASK_MAPPING_REQUIRED' WHEN coalesce(g, '') = '' THEN 'EMBED_GROUPS_MISSING' WHEN trim(coalesce(q, '')) = '' OR trim(coalesce(d, '')) = '' THEN 'EMBED_TEXT_REQUIRED' END AS error FROM f)
SELECT key, CASE WHEN error IS NULL THEN 'pair' END AS task, CASE WHEN error IS NULL THEN g END AS "group", CASE WHEN error IS NULL THEN q END AS query, CASE WHEN error IS NULL THEN length(d)::INTEGER END AS document_chars, error FROM e""",
    "record_issues": f"""WITH t AS (SELECT record_id, bool_or({_TRIM} = '') AS blank, bool_or(coalesce(text_hash <> sha256(to_json(text)::VARCHAR), true)) AS stale FROM embedding_texts GROUP BY 1),
w AS (SELECT record_id, norm, len(vec) <> dimension AS size, len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AS finite, vec FROM embedding_vectors WHERE storage_kind = 'inline' AND vec IS NOT NULL),
v AS (SELECT record_id, bool_or(size OR NOT finite) AS shape, bool_or(norm = 'l2' AND finite AND abs(sqrt(list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-5) AS norm FROM w GROUP BY 1),
r AS (SELECT r.record_id, CASE WHEN coalesce(split_group, '') = '' OR coalesce(split, '') = '' OR coalesce(revision, '') = '' OR coalesce(license, '') = '' OR coalesce(rights, '') = '' THEN 'EMBED_PROVENANCE_REQUIRED'
 WHEN blank THEN 'EMBED_TEXT_REQUIRED' WHEN stale THEN 'EMBED_TEXT_HASH'
 WHEN kind IN ('scored-pair', 'sts', 'teacher-score') AND NOT coalesce(scale_min < scale_max AND score BETWEEN scale_min AND scale_max, false) THEN 'EMBED_SCORE_SCALE' WHEN shape THEN 'EMBED_VECTOR_SHAPE' WHEN v.norm THEN 'EMBED_VECTOR_NORM' END AS code
 FROM embedding_records r LEFT JOIN t USING (record_id) LEFT JOIN v USING (record_id)) SELECT * FROM r WHERE code IS NOT NULL""",
    "record_global_issues": """SELECT 'EMBED_DUPLICATE_ID' AS code, record_id AS subject, count(*) - 1 AS times FROM embedding_records GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'EMBED_GLOBAL_TEXT_ID_CONFLICT', id, count(*) FROM (SELECT id, text_hash, lag(text_hash) OVER (PARTITION BY id ORDER BY text_key) AS prior FROM embedding_texts) WHERE prior <> text_hash GROUP BY 2
UNION ALL SELECT 'EMBED_POSITIVE_NEGATIVE_CONFLICT', record_id, count(*) FROM (SELECT record_id, id FROM embedding_texts GROUP BY ALL HAVING bool_or(text_role IN ('positive', 'positives')) AND bool_or(text_role IN ('negative', 'negatives'))) GROUP BY 2
UNION ALL SELECT 'EMBED_VECTOR_DIMENSION_INCONSISTENT', '$', count(DISTINCT dimension) FROM embedding_vectors HAVING count(DISTINCT dimension) > 1""",
    "inspect_counts": """SELECT 'kind:' || coalesce(kind, 'null') AS slice, count(*) AS records, count(DISTINCT split_group) AS groups FROM embedding_records GROUP BY kind
UNION ALL SELECT 'split:' || coalesce(split, 'null'), count(*), count(DISTINCT split_group) FROM embedding_records GROUP BY split UNION ALL SELECT 'all', count(*), count(DISTINCT split_group) FROM embedding_records""",
    "hard_negatives": r"""WITH q AS (SELECT a.text_key AS query_id, p.id AS positive, p.text AS pt FROM embedding_texts a JOIN embedding_texts p USING (record_id) WHERE a.text_role = 'anchor' AND p.text_role = 'positive'),
c AS (SELECT a.text_key AS query_id, n.id AS document, n.text FROM embedding_texts a JOIN embedding_texts n USING (record_id) WHERE a.text_role = 'anchor' AND n.text_role = 'negative'),
w AS (SELECT *, list_distinct(string_split_regex(lower(text), '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+')) AS a, list_distinct(string_split_regex(lower(pt), '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+')) AS b FROM c JOIN q USING (query_id))
SELECT query_id, document, CASE WHEN document = positive THEN 'positive' WHEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) >= 0.9 THEN 'near-duplicate' ELSE 'kept' END AS outcome FROM w""",
    "governed_logs": f"""WITH l AS (SELECT *, list_transform(messages, lambda m: regexp_replace(regexp_replace(m.content, '{_EM}', '[EMAIL]', 'g'), '{_PH}', '[PHONE]', 'g')) AS t FROM production_logs)
SELECT sha256(to_json(source_name || ':' || log_id || ':' || revision)::VARCHAR) AS record_id, log_id, CASE WHEN bad THEN NULL ELSE len(messages)::INTEGER END AS messages, CASE WHEN bad THEN 'LOG_REDACTION_INCOMPLETE' END AS error
FROM (SELECT *, len(list_filter(t, lambda x: coalesce(regexp_matches(x, '{_EM}') OR regexp_matches(x, '{_PH}') OR regexp_matches(x, '{_SE}'), false))) > 0 AS bad FROM l)""",
    "leakage_groups": f"SELECT example_id, {_LEAK} AS leakage_group FROM chat_examples",
    "distill_training_rows": f"""WITH d AS (SELECT example_id, split, {_LEAK} AS g, messages[-1].role AS role, coalesce(array_to_string(list_transform(list_filter(messages[-1].content, lambda p: p.type = 'text'), lambda p: coalesce(p.text, '')), chr(10)), '') AS text FROM chat_examples),
u AS (SELECT *, ('0x' || substr(sha256('s' || chr(0) || g), 1, 12))::BIGINT / 281474976710655::DOUBLE AS u FROM d)
SELECT min(example_id) AS example_id, count(DISTINCT example_id) AS copies FROM u WHERE role = 'assistant' AND coalesce(CASE WHEN split <> 'train' THEN split END, CASE WHEN u < 0.8 THEN 'train' ELSE 'x' END) = 'train'
 AND NOT regexp_matches(text, '{_EM}') AND NOT regexp_matches(text, '{_PH}') AND NOT regexp_matches(text, '{_SE}') AND {_TRIM} <> '' GROUP BY lower(text)""",
    "provenance_manifest": "SELECT array_to_string(list_sort(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)), ',') AS kinds, array_to_string(list_sort(list(DISTINCT revision) FILTER (WHERE revision IS NOT NULL)), ',') AS revisions, count(DISTINCT split_group) AS groups, count(*) AS records FROM embedding_records",
}
SQL["family_splits"] = SQL["lineage_components_whole"].rsplit("SELECT r AS record_id", 1)[0].rstrip() + """,
z AS (SELECT n.record_id AS r, coalesce(c, n.record_id) AS c FROM n LEFT JOIN c ON r = n.record_id), g AS (SELECT c, min(k) AS root FROM z JOIN p USING (r) GROUP BY c),
f AS (SELECT r, coalesce(root, z.c) AS root FROM z LEFT JOIN g ON g.c = z.c), hu AS (SELECT *, ('0x' || substr(sha256(to_json('s' || chr(0) || root)::VARCHAR), 1, 13))::BIGINT / 4503599627370495::DOUBLE AS u FROM f)
SELECT r AS record_id, root, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM hu"""
