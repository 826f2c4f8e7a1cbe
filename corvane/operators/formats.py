"""The thirteen kinds of embedding records: decoding external JSON rows, encoding them, validating them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.canonical import canonical_json
from corvane.functions.text import text_hash, trim_all
from corvane.operators.records import KNOWN, detect_task
from corvane.session import table

# Of each task the roles that are texts, with the columns a role may stand in, in order ("*" may be missing, "[]" is an array).
TEXT_ROLES = {
    "pair": "query:query,anchor document:document,positive negative*:negative",
    "triplet": "anchor:anchor,query positive:positive,document negative:negative",
    "retrieval-set": "query:query,anchor positives[]:positives,positive negatives[]:negatives,negative",
    "classification": "text:text", "clustering": "text:text", "instruction-aware": "text:text", "teacher-vector": "text:text", "teacher-ranking": "query:query",
    "scored-pair": "left:left,text1,query right:right,text2,document", "sts": "left:left,text1,query right:right,text2,document",
    "boolean-pair": "left:left,text1,query right:right,text2,document", "categorical-pair": "left:left,text1,query right:right,text2,document",
    "teacher-score": "query:left,text1,query document:right,text2,document",
}
# Of each kind the columns of its external row besides id and split_group.
EXTERNAL = {
    "query-document": "query document", "triplet": "anchor positive negative", "retrieval-set": "query positives negatives", "classification": "text label labels", "clustering": "text label labels",
    "scored-pair": "left right score score_min score_max score_direction", "sts": "left right score score_min score_max score_direction", "boolean-pair": "left right label", "categorical-pair": "left right label labels",
    "teacher-vector": "text teacher vector norm", "teacher-score": "query document teacher score scale margin", "teacher-ranking": "query teacher candidate_pool_id corpus_id candidates ranking", "instruction-aware": "instruction text role",
}
RECORD = (
    "record_id string, kind string, `group` string, texts array<struct<role: string, pos: int, text: string, text_hash: string>>, label string, label_is_boolean boolean, label_domain array<string>, score double, scale_min double, scale_max double, "
    "scale_direction string, margin double, instruction string, text_role string, teacher string, vector array<double>, dimension int, norm string, storage string, candidate_pool_id string, corpus_id string, candidates array<struct<id: string, documentId: string>>, ranking array<string>"
)


def _kind(v: Column) -> Column:
    """Type of a variant value; null where there is none."""
    return F.schema_of_variant(v)


def _once(c: Column) -> Column:
    """``c``, computed once: a fence that keeps the optimizer from copying it into every expression that uses it."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _of(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", v.try_cast("string"))


def _role_table() -> Column:
    """``TEXT_ROLES`` as a literal map of task to its roles."""
    entries = []
    for task, spec in TEXT_ROLES.items():
        roles = [F.struct(F.lit(r.rstrip("*[]")).alias("role"), F.array(*map(F.lit, names.split(","))).alias("names"), F.lit(r.endswith("[]")).alias("many"), F.lit(r.endswith("*")).alias("may")) for r, names in (x.split(":") for x in spec.split())]
        entries += [F.lit(task), F.array(*roles)]
    return F.create_map(*entries)


def _strings(x: Column) -> Column:
    """A variant's strings: its own, or those of its array (null where a member is none); null for all else."""
    return F.when(_kind(x) == "STRING", F.array(x.try_cast("string"))).when(F.startswith(_kind(x), F.lit("ARRAY")), F.transform(x.try_cast("array<variant>"), _string))


def _texts(roles: Column, by_column: Column) -> tuple[Column, Column]:
    """Texts of a task's roles as an array of (role, pos, text), and whether one is missing or blank.

    A role stands in the first of its columns that the row has; one with many texts must be an array.
    """
    column = lambda r: F.get(F.filter(r["names"], lambda n: F.map_contains_key(by_column, n)), 0)
    found = F.transform(roles, lambda r: F.struct(r["role"].alias("role"), r["many"].alias("many"), (r["may"] & column(r).isNull()).alias("left_out"), F.try_element_at(by_column, column(r)).alias("held")))
    texts = F.flatten(F.transform(F.filter("found", lambda f: ~f["left_out"]), lambda f: F.transform(F.coalesce(f["held"]["texts"], F.array()), lambda t, i: F.struct(f["role"].alias("role"), i.cast("int").alias("pos"), t.alias("text")))))
    blank = lambda f: F.exists(f["held"]["texts"], lambda t: F.coalesce(trim_all(t), F.lit("")) == "")
    bad = F.exists("found", lambda f: ~f["left_out"] & (f["held"]["texts"].isNull() | F.coalesce(f["held"]["array"] != f["many"], F.lit(True)) | F.coalesce(blank(f), F.lit(True))))
    return found, F.struct(texts.alias("texts"), bad.alias("bad"))


def record_error(checked_task: Column | None = None) -> Column:
    """First rule that a record (columns of ``RECORD``) breaks; null where it holds.

    In order: provenance, blank text, stale text hash, score scale, label domain, instruction apart from
    its text, ranking pool, teacher, vector shape and norm, positives there and apart from negatives.
    """
    kind = F.col("kind")
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    no = lambda x: F.coalesce(c(x), F.lit("")) == ""
    finite = lambda x: c(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    in_scale = finite("score") & finite("scale_min") & finite("scale_max") & (c("scale_min") < c("scale_max")) & c("score").between(c("scale_min"), c("scale_max"))
    domain = F.when(kind == "boolean-pair", c("label_is_boolean")).otherwise(F.array_contains("label_domain", c("label")))
    ids = F.transform("candidates", lambda x: x["id"])
    pool = ~no("candidate_pool_id") & ~no("corpus_id") & (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_distinct("ranking")) == F.size("ranking")) & (F.size(F.array_except("ranking", ids)) == 0)
    teacher = F.try_parse_json(c("teacher"))
    has = lambda k: F.coalesce(_of(teacher, k).try_cast("string"), F.lit("")) != ""
    inline = (kind == "teacher-vector") & (F.coalesce(c("storage"), F.lit("inline")) == "inline")
    shape = (F.size("vector") == c("dimension")) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    hashes = lambda role: F.transform(F.filter("texts", lambda t: t["role"] == role), lambda t: t["text_hash"])
    plain = F.element_at(F.filter("texts", lambda t: t["role"] == "text"), 1)["text"]
    return (
        F.when(no("record_id") | no("group"), "EMBED_PROVENANCE_REQUIRED")
        .when(yes(F.exists("texts", lambda t: F.coalesce(trim_all(t["text"]), F.lit("")) == "")), "EMBED_TEXT_REQUIRED")
        .when(yes(F.exists("texts", lambda t: t["text_hash"] != text_hash(t["text"]))), "EMBED_TEXT_HASH")
        .when(kind.isin("scored-pair", "sts", "teacher-score") & ~yes(in_scale), "EMBED_SCORE_SCALE")
        .when(kind.isin("categorical-pair", "classification", "clustering", "boolean-pair") & ~yes(domain), "EMBED_LABEL_DOMAIN")
        .when((kind == "instruction-aware") & (~yes(trim_all(c("instruction")) != "") | yes(F.startswith(plain, c("instruction")))), "EMBED_INSTRUCTION_SEPARATION")
        .when((kind == "teacher-ranking") & ~yes(pool), "EMBED_RANKING_POOL")
        .when(kind.startswith("teacher-") & ~yes(has("revision") & has("requestId")), "EMBED_TEACHER_PROVENANCE")
        .when(inline & ~yes(shape), "EMBED_VECTOR_SHAPE").when(inline & (c("norm") == "l2") & ~yes(F.abs(length - 1) <= 1e-5), "EMBED_VECTOR_NORM")
        .when((kind == "retrieval-set") & (F.size(hashes("positives")) == 0), "EMBED_POSITIVE_REQUIRED")
        .when((kind == "retrieval-set") & yes(F.arrays_overlap(hashes("positives"), hashes("negatives"))), "EMBED_POSITIVE_NEGATIVE_CONFLICT")
    )


def decode_records(rows: DataFrame, group_column: str = "split_group") -> DataFrame:
    """JSON rows ``(key, payload[, task])`` to ``key``, the columns of ``RECORD``, ``extra`` and ``error``.

    A row's task is its ``task`` where given, else it is told by its columns. Texts of every role are
    required; columns of no role stay as canonical JSON in ``extra``. A record's id is its ``id`` if that
    is a string, else the hash of task, group and content. A row that is no JSON object, of no clear task,
    without a group or text, or that breaks a rule of its kind has its first code in ``error`` and nulls
    elsewhere. Null payloads count as broken; an empty table gives an empty result; other columns go.
    """
    task_given = F.col("task") if "task" in rows.columns else F.lit(None).cast("string")
    d = rows.select("key", "payload", task_given.alias("given")).withColumn("v", F.try_parse_json("payload"))
    keys = F.json_object_keys(F.when(F.col("v").isNotNull(), F.col("payload")))
    d = d.withColumn("keys", keys).withColumn("task", _once(F.coalesce("given", detect_task(F.col("keys")))))
    v, ks, task = F.col("v"), F.col("keys"), F.col("task")
    columns = sorted({n for spec in TEXT_ROLES.values() for x in spec.split() for n in x.split(":")[1].split(",")})
    held = [F.when(F.array_contains(ks, n), F.struct(F.lit(n).alias("n"), _of(v, n).alias("x"))) for n in columns]
    by_column = F.map_from_entries(F.transform(F.array_compact(F.array(*held)), lambda e: F.struct(e["n"], F.struct(_strings(e["x"]).alias("texts"), F.startswith(_kind(e["x"]), F.lit("ARRAY")).alias("array")))))
    d = d.withColumn("by_column", by_column).withColumn("roles", F.try_element_at(_role_table(), F.coalesce("task", F.lit(""))))
    found, texts = _texts(F.col("roles"), F.col("by_column"))
    group = F.coalesce(_of(v, group_column).try_cast("string"), F.lit(""))
    d = d.withColumn("found", _once(found)).withColumn("t", texts).select("key", "payload", "v", "keys", "task", _once(F.col("t.texts")).alias("texts"), F.coalesce("t.bad", F.lit(True)).alias("blank"), group.alias("group"))
    first = (
        F.when(F.col("v").isNull() | F.col("keys").isNull(), "EMBED_JSON").when(task.startswith("error:"), F.substring("task", 7, 100)).when(F.col("group") == "", "EMBED_GROUPS_MISSING")
        .when(~task.isin(*TEXT_ROLES), "EMBED_UNSUPPORTED_TASK").when(F.col("blank"), "EMBED_TEXT_REQUIRED")
    )
    at = lambda name, kind: _of(v, name).try_cast(kind)
    scale = lambda name, kind: F.when(task == "teacher-score", _of(_of(v, "scale"), name).try_cast(kind)).otherwise(at(f"score_{name}", kind))
    negative = F.exists("texts", lambda t: t["role"] == "negative")
    vector = at("vector", "array<double>")
    roles = {"query": "anchor", "document": "positive", "negative": "negative"}  # a pair with a negative is a triplet
    renamed = F.transform("texts", lambda t: F.struct(F.when((task == "pair") & negative, F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in roles.items() for x in kv)), t["role"]), t["role"])).otherwise(t["role"]).alias("role"), t["pos"].alias("pos"), t["text"].alias("text"), text_hash(t["text"]).alias("text_hash")))
    own = F.when(_kind(_of(v, "id")) == "STRING", at("id", "string"))
    used = lambda *kinds: F.lit(False) if not kinds else task.isin(*kinds)
    when = lambda x, *kinds: F.when(used(*kinds), x)
    pairs = ("scored-pair", "sts", "teacher-score")
    extra = F.array_except(ks, F.array(*map(F.lit, (*KNOWN, group_column))))
    r = d.select(
        "key", "payload", "v", first.alias("first"), extra.alias("rest"), F.coalesce(own, F.sha2(F.concat_ws("\x00", "task", "group", "payload"), 256)).alias("record_id"),
        F.when((task == "pair") & negative, "triplet").when(task == "pair", "query-document").otherwise(task).alias("kind"), "group", _once(renamed).alias("texts"),
        when(at("label", "string"), "classification", "clustering", "boolean-pair", "categorical-pair").alias("label"), when(F.coalesce(_kind(_of(v, "label")) == "BOOLEAN", F.lit(False)), "boolean-pair").alias("label_is_boolean"),
        when(at("labels", "array<string>"), "classification", "clustering", "categorical-pair").alias("label_domain"), when(at("score", "double"), *pairs).alias("score"), when(scale("min", "double"), *pairs).alias("scale_min"), when(scale("max", "double"), *pairs).alias("scale_max"),
        when(scale("direction", "string"), *pairs).alias("scale_direction"), when(at("margin", "double"), "teacher-score").alias("margin"), when(at("instruction", "string"), "instruction-aware").alias("instruction"), when(at("role", "string"), "instruction-aware").alias("text_role"),
        when(F.get_json_object("payload", "$.teacher"), "teacher-vector", "teacher-score", "teacher-ranking").alias("teacher"), when(vector, "teacher-vector").alias("vector"), when(F.size(vector), "teacher-vector").alias("dimension"),
        when(F.coalesce(at("norm", "string"), F.lit("none")), "teacher-vector").alias("norm"), when(F.lit("inline"), "teacher-vector").alias("storage"), when(at("candidate_pool_id", "string"), "teacher-ranking").alias("candidate_pool_id"), when(at("corpus_id", "string"), "teacher-ranking").alias("corpus_id"),
        when(F.from_json(F.get_json_object("payload", "$.candidates"), "array<struct<id: string, documentId: string>>"), "teacher-ranking").alias("candidates"), when(at("ranking", "array<string>"), "teacher-ranking").alias("ranking"),
    )
    r = r.withColumn("error", _once(F.coalesce("first", record_error())))
    kept = F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, _: F.array_contains("rest", k))
    r = r.withColumn("extra", F.when(F.size("rest") > 0, canonical_json(F.to_json(kept))))
    cols = [x.split(" ")[0].strip("`") for x in RECORD.replace("struct<role: string, pos: int, text: string, text_hash: string>", "x").replace("struct<id: string, documentId: string>", "x").split(", ")]
    return r.select("key", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in (*cols, "extra")), "error")


def encode_records(records: DataFrame) -> DataFrame:
    """Records (columns of ``RECORD``) as external rows: ``(record_id, kind, value, loss)``, ``value`` JSON with the columns of its kind.

    A vector kept in a shard cannot be written without one (``EMBED_VECTOR_SIDECAR_REQUIRED``), a kind
    without an external form only canonically (``EMBED_UNSUPPORTED_EXPORT``); such rows have a null value.
    """
    one = lambda role: F.element_at(F.filter("texts", lambda t: t["role"] == role), 1)["text"]
    many = lambda role: F.transform(F.array_sort(F.filter("texts", lambda t: t["role"] == role), lambda a, b: a["pos"] - b["pos"]), lambda t: t["text"])
    c = F.col
    value = {
        **{r: one(r) for r in ("query", "document", "anchor", "positive", "negative", "text", "left", "right")}, "positives": many("positives"), "negatives": many("negatives"), "label": c("label"), "labels": c("label_domain"), "score": c("score"), "score_min": c("scale_min"), "score_max": c("scale_max"),
        "score_direction": c("scale_direction"), "teacher": F.try_parse_json(c("teacher")), "vector": c("vector"), "norm": c("norm"), "scale": F.struct(c("scale_min").alias("min"), c("scale_max").alias("max"), c("scale_direction").alias("direction")), "margin": c("margin"),
        "candidate_pool_id": c("candidate_pool_id"), "corpus_id": c("corpus_id"), "candidates": c("candidates"), "ranking": c("ranking"), "instruction": c("instruction"), "role": c("text_role"),
    }
    out = F.lit(None).cast("string")
    for kind, names in EXTERNAL.items():
        fields = [value[n].cast("boolean").alias(n) if kind == "boolean-pair" and n == "label" else value[n].alias(n) for n in names.split()]
        out = F.when(c("kind") == kind, F.to_json(F.struct(c("record_id").alias("id"), c("group").alias("split_group"), *fields))).otherwise(out)
    loss = F.when((c("kind") == "teacher-vector") & (F.coalesce(c("storage"), F.lit("inline")) == "shard"), "EMBED_VECTOR_SIDECAR_REQUIRED").when(~F.coalesce(c("kind").isin(*EXTERNAL), F.lit(False)), "EMBED_UNSUPPORTED_EXPORT")
    return records.select("record_id", "kind", F.when(loss.isNull(), out).alias("value"), loss.alias("loss"))


def assemble(records: DataFrame, texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Records, texts and vectors of the data set as rows of ``RECORD``: each record's latest delivery with all its texts."""
    latest = records.groupBy("record_id").agg(F.max_by(F.struct("kind", "split_group", "label", "score", "scale_min", "scale_max", "scale_direction"), "ingested_at").alias("r"))
    t = texts.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(F.col("text_role").alias("role"), F.coalesce("pos", F.lit(0)).cast("int").alias("pos"), F.coalesce("text", F.lit("")).alias("text"), text_hash(F.coalesce("text", F.lit(""))).alias("text_hash")))).alias("texts"))  # one record's texts
    v = vectors.groupBy("record_id").agg(F.min_by(F.struct(F.col("vec").cast("array<double>").alias("vec"), "dimension", "norm", "storage_kind", "model", "revision"), "vec_key").alias("v"))
    kind = F.col("r.kind")
    teacher = F.when(kind == "teacher-vector", F.to_json(F.struct(F.col("v.model").alias("model"), F.col("v.revision").alias("revision"), F.col("record_id").alias("requestId"))))
    none = lambda t: F.lit(None).cast(t)
    return latest.join(t, "record_id", "left").join(v, "record_id", "left").select(
        "record_id", kind.alias("kind"), F.col("r.split_group").alias("group"), F.coalesce("texts", F.array()).alias("texts"), F.col("r.label").alias("label"), F.col("r.label").isin("true", "false").alias("label_is_boolean"),
        F.when(F.col("r.label").isNotNull(), F.array("r.label")).alias("label_domain"), F.col("r.score").alias("score"), F.col("r.scale_min").alias("scale_min"), F.col("r.scale_max").alias("scale_max"), F.col("r.scale_direction").alias("scale_direction"), none("double").alias("margin"),
        F.when(kind == "instruction-aware", F.lit("Find what answers this")).alias("instruction"), F.when(kind == "instruction-aware", "query").alias("text_role"), teacher.alias("teacher"), F.col("v.vec").alias("vector"), F.col("v.dimension").alias("dimension"), F.col("v.norm").alias("norm"),
        F.col("v.storage_kind").alias("storage"), none("string").alias("candidate_pool_id"), none("string").alias("corpus_id"), none("array<struct<id: string, documentId: string>>").alias("candidates"), none("array<string>").alias("ranking"),
    )


def _records(s: SparkSession, d: str) -> DataFrame:
    return assemble(*(table(s, d, f"embedding_{n}") for n in ("records", "texts", "vectors")))


def _encoded(s: SparkSession, d: str) -> DataFrame:
    e = encode_records(_records(s, d))
    return e.select("record_id", "kind", "loss", F.array_join(F.array_sort(F.json_object_keys("value")), ",").alias("columns"))


def _decoded(s: SparkSession, d: str) -> DataFrame:
    e = encode_records(_records(s, d)).filter("value IS NOT NULL")
    # vectors and scores as they are, and pairs and triplets told by their columns
    task = F.when(~F.col("kind").isin("query-document", "triplet", "retrieval-set", "teacher-vector"), F.col("kind"))
    got = decode_records(e.select(F.col("record_id").alias("key"), F.col("value").alias("payload"), task.alias("task")))
    chars = F.aggregate("texts", F.lit(0), lambda n, t: n + F.length(t["text"]))
    return got.select("key", "kind", F.size("texts").alias("texts"), chars.alias("chars"), "label", "score", "dimension", "error")


def _checked(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).withColumn("error", record_error()).groupBy("kind", "error").agg(F.count(F.lit(1)).alias("records"))


QUERIES = {"record_kinds_encode": _encoded, "record_kinds_decode": _decoded, "record_kinds_validate": _checked}

_BASE = r"""l AS (SELECT * FROM embedding_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) = 1),
t AS (SELECT record_id, count(*) AS n, sum(length(coalesce(text, ''))) AS chars, bool_or(trim(coalesce(text, '')) = '') AS blank,
 list(text) FILTER (WHERE text_role = 'positives') AS p, list(text) FILTER (WHERE text_role = 'negatives') AS q, max(text) FILTER (WHERE text_role = 'text') AS plain FROM embedding_texts GROUP BY 1),
v AS (SELECT record_id, arg_min(vec, vec_key) FILTER (WHERE vec IS NOT NULL) AS dummy, min(vec_key) AS k FROM embedding_vectors GROUP BY 1), w AS (SELECT e.* FROM v JOIN embedding_vectors e ON e.vec_key = v.k),
b AS (SELECT l.record_id, l.kind, l.split_group, label, score, scale_min, scale_max, coalesce(n, 0) AS n, coalesce(chars, 0) AS chars, coalesce(blank, false) AS blank, p, q, plain, vec, dimension, norm, storage_kind FROM l LEFT JOIN t USING (record_id) LEFT JOIN w USING (record_id)),
e AS (SELECT *, CASE WHEN coalesce(split_group, '') = '' THEN 'EMBED_PROVENANCE_REQUIRED' WHEN blank THEN 'EMBED_TEXT_REQUIRED'
 WHEN kind = 'sts' AND NOT coalesce(scale_min < scale_max AND score BETWEEN scale_min AND scale_max, false) THEN 'EMBED_SCORE_SCALE'
 WHEN kind = 'classification' AND label IS NULL OR kind = 'boolean-pair' AND NOT coalesce(label IN ('true', 'false'), false) THEN 'EMBED_LABEL_DOMAIN'
 WHEN kind = 'instruction-aware' AND starts_with(plain, 'Find what answers this') THEN 'EMBED_INSTRUCTION_SEPARATION'
 WHEN kind = 'teacher-vector' AND (SELECT coalesce(w.revision, '') = '' FROM w WHERE w.record_id = b.record_id) IS NOT FALSE THEN 'EMBED_TEACHER_PROVENANCE'
 WHEN kind = 'teacher-vector' AND coalesce(storage_kind, 'inline') = 'inline' AND NOT coalesce(len(vec) = dimension AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0, false) THEN 'EMBED_VECTOR_SHAPE'
 WHEN kind = 'teacher-vector' AND coalesce(storage_kind, 'inline') = 'inline' AND norm = 'l2' AND abs(sqrt(list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-5 THEN 'EMBED_VECTOR_NORM'
 WHEN kind = 'retrieval-set' AND coalesce(len(p), 0) = 0 THEN 'EMBED_POSITIVE_REQUIRED' WHEN kind = 'retrieval-set' AND list_has_any(p, q) THEN 'EMBED_POSITIVE_NEGATIVE_CONFLICT' END AS error FROM b)
"""
_SHARD = "kind = 'teacher-vector' AND coalesce(storage_kind, 'inline') = 'shard'"
_COLUMNS = " ".join(f"WHEN '{k}' THEN {sorted(['id', 'split_group', *v.split()])}" for k, v in EXTERNAL.items())
_OK = "CASE WHEN error IS NULL THEN {} END AS {}"
SQL = {
    "record_kinds_validate": f"WITH {_BASE} SELECT kind, error, count(*) AS records FROM e GROUP BY ALL",
    "record_kinds_encode": f"""WITH {_BASE} SELECT record_id, kind, CASE WHEN {_SHARD} THEN 'EMBED_VECTOR_SIDECAR_REQUIRED' END AS loss,
 CASE WHEN NOT ({_SHARD}) THEN array_to_string(list_filter(CASE kind {_COLUMNS} END, lambda c: NOT (c = 'split_group' AND split_group IS NULL OR c IN ('label', 'labels') AND label IS NULL OR c = 'score' AND score IS NULL OR c = 'vector' AND vec IS NULL OR c = 'norm' AND norm IS NULL)), ',') END AS columns FROM e""",
    "record_kinds_decode": f"""WITH {_BASE}, c AS (SELECT * REPLACE (CASE error WHEN 'EMBED_PROVENANCE_REQUIRED' THEN 'EMBED_GROUPS_MISSING' ELSE error END AS error) FROM e WHERE NOT ({_SHARD}))
SELECT record_id AS key, {_OK.format("kind", "kind")}, {_OK.format("n::INTEGER", "texts")}, {_OK.format("chars::INTEGER", "chars")}, CASE WHEN error IS NULL AND kind IN ('classification', 'boolean-pair') THEN label END AS label,
 CASE WHEN error IS NULL AND kind = 'sts' THEN score END AS score, CASE WHEN error IS NULL AND kind = 'teacher-vector' THEN len(vec)::INTEGER END AS dimension, error FROM c""",
}
