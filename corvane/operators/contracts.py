"""Contracts as rules over tables: what configurations, targets, requests and tool definitions must hold; provider messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.chat import message_text
from corvane.plans.ranks import numbered
from corvane.session import table


def broken(rows: DataFrame, rules: dict[str, Column], key: str = "key") -> DataFrame:
    """``(key, code)`` for every rule that a row breaks: a condition that is true, or unknown, breaks it."""
    codes = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in rules.items())))
    return rows.select(key, F.explode(codes).alias("code"))


def attestations(configs: DataFrame, required: tuple[str, ...], key: str = "key") -> DataFrame:
    """``(key, code)`` ``MISSING:field`` for each required boolean or text column that is false, blank or null."""

    def missing(c: str) -> Column:
        return F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")).isin("", "false")

    return broken(configs, {f"MISSING:{c}": missing(c) for c in required}, key)


def preflight(locks: DataFrame) -> DataFrame:
    """``(key, code)`` of the gates a model lock and its input fail.

    Columns: ``status, commit, license_sha256, dataset_rights, teacher_rights, split_groups, remote_code, reviewed_commit, prompt,
    pooling, padding, normalization, safe_dimensions array, dimension, dependencies_compatible, contamination_hash, intended_use, wanted_use``.
    """
    c = F.col
    blank = lambda n: F.coalesce(c(n), F.lit("")) == ""
    rules = {
        "EMBED_LOCK_UNAVAILABLE": c("status") != "available", "EMBED_MUTABLE_REVISION": ~c("commit").rlike("^[a-f0-9]{40}$"), "EMBED_LICENSE_MUTATED": blank("license_sha256"), "EMBED_RIGHTS_MISSING": blank("dataset_rights") | blank("teacher_rights"),
        "EMBED_GROUPS_MISSING": ~c("split_groups"), "EMBED_REMOTE_CODE_UNREVIEWED": F.coalesce(c("remote_code"), F.lit(False)) & blank("reviewed_commit"), "EMBED_CONVENTION_UNKNOWN": F.array_contains(F.array("prompt", "pooling", "padding", "normalization"), "unknown"),
        "EMBED_DIMENSION_UNSAFE": ~F.array_contains("safe_dimensions", c("dimension")), "EMBED_DEPENDENCY_INCOMPATIBLE": ~c("dependencies_compatible"), "EMBED_CONTAMINATION_MISSING": blank("contamination_hash"), "EMBED_INTENDED_USE_CONFLICT": ~F.contains(c("intended_use"), c("wanted_use")),
    }
    return broken(locks, rules)


def logit_target_errors(targets: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """``(key, code)`` of ``targets(key, positions array, probabilities array, residual)``: repeated positions, a mass that is not one, too many bytes."""
    p, total = F.col("probabilities"), F.aggregate("probabilities", F.lit(0.0), lambda s, x: s + x)
    rules = {
        "LOGIT_POSITIONS": (F.size(F.array_distinct("positions")) != F.size("positions")) | (F.size("positions") != F.size(p)) | F.exists("positions", lambda i: i < 0),
        "LOGIT_MASS": F.exists(p, lambda x: F.isnan(x) | (x < 0)) | (F.abs(total + F.col("residual") - 1) > 1e-6), "LOGIT_BYTES": F.octet_length(F.to_json(F.struct("positions", "probabilities", "residual"))) > max_bytes,
    }
    return broken(targets, rules)


def feature_target_errors(targets: DataFrame) -> DataFrame:
    """``(key, code)`` of ``targets(key, student array, teacher array, projection array<array>)``: dimensions must align, over the projection if there is one."""
    s, t, m = F.col("student"), F.col("teacher"), F.col("projection")
    plain = F.size(s) != F.size(t)
    matrix = (F.size(m) != F.size(s)) | F.exists(m, lambda r: F.size(r) != F.size(t))
    return broken(targets, {"FEATURE_DIMENSIONS": F.when(m.isNull(), plain).otherwise(matrix), "FEATURE_VALUES": F.exists(F.concat(s, t), lambda x: x.isNull() | F.isnan(x))})


def request_errors(requests: DataFrame, payload_bytes: int = 1_000_000, runtime_s: int = 600, queue_s: int = 1800) -> DataFrame:
    """``(key, code)`` of ``requests(key, payload, runtime_s, queue_s, min_workers, max_workers)`` beyond what a serverless endpoint takes."""
    c = F.col
    return broken(requests, {"PAYLOAD_TOO_LARGE": F.octet_length("payload") > payload_bytes, "RUNTIME": ~c("runtime_s").between(1, runtime_s), "QUEUE_TTL": ~c("queue_s").between(1, queue_s), "SCALING": (c("min_workers") < 0) | (c("max_workers") < 1) | (c("min_workers") > c("max_workers"))})


def module_coverage(runs: DataFrame, least: float = 1.0) -> DataFrame:
    """``runs(key, wanted array, found array)`` with the part of the wanted modules that is there, those missing, and whether it suffices."""
    want = F.array_distinct("wanted")
    gone = F.array_except(want, "found")
    ratio = 1 - F.try_divide(F.size(gone), F.size(want))
    return runs.select("key", F.coalesce(ratio, F.lit(0.0)).alias("coverage"), F.array_sort(gone).alias("missing"), F.coalesce(ratio >= least, F.lit(False)).alias("ok"))


def isolated(runs: DataFrame) -> DataFrame:
    """``(what, value, times)`` of run prefixes and attempt ids that ``runs(prefix, attempt)`` has more than once."""
    both = runs.select(F.explode(F.array(F.struct(F.lit("prefix").alias("what"), F.col("prefix").cast("string").alias("value")), F.struct(F.lit("attempt").alias("what"), F.col("attempt").cast("string").alias("value")))).alias("x"))
    return both.filter("x.value IS NOT NULL").groupBy("x.what", "x.value").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def audit_tokenizer(examples: DataFrame) -> DataFrame:
    """One row of flags over ``examples(ids, round_trip, has_generation, prefix_stable)``: true where every example holds."""
    return examples.agg(F.count(F.lit(1)).alias("examples"), *(F.coalesce(F.bool_and(F.coalesce(F.col(c), F.lit(False))), F.lit(False)).alias(c) for c in ("round_trip", "has_generation", "prefix_stable")))


def vocabulary_errors(maps: DataFrame) -> DataFrame:
    """``(key, code)`` of ``maps(key, mapping map<int,int>)``: no negative id, and one to one."""
    v = F.map_values("mapping")
    return broken(maps, {"VOCABULARY_NEGATIVE": F.exists(F.concat(v, F.map_keys("mapping")), lambda x: x < 0), "VOCABULARY_NOT_ONE_TO_ONE": F.size(F.array_distinct(v)) != F.size(v)})


def persona_errors(replies: DataFrame) -> DataFrame:
    """``(key, code)`` of model replies ``(key, text)`` that must be a JSON array of personas with different ids, names and goals."""
    p = F.from_json("text", "array<struct<id: string, name: string, goal: string>>")
    ids = F.transform(p, lambda x: x["id"])
    return broken(replies, {"PERSONA_JSON": F.try_parse_json("text").isNull() | p.isNull(), "PERSONA_FIELDS": F.exists(p, lambda x: F.coalesce(x["id"], F.lit("")).eqNullSafe("") | F.coalesce(x["name"], F.lit("")).eqNullSafe("") | F.coalesce(x["goal"], F.lit("")).eqNullSafe("")), "PERSONA_IDS": F.size(F.array_distinct(ids)) != F.size(ids)})


def tool_definition_errors(rows: DataFrame) -> DataFrame:
    """``(key, tool, code)`` of ``rows(key, tools array<struct<type, name, parameters>>)``: function type, a name once, object parameters."""
    names = F.transform("tools", lambda t: t["name"])
    d = rows.select("key", names.alias("names"), F.posexplode("tools").alias("i", "t"))
    kind = F.get_json_object("t.parameters", "$.type")
    codes = F.array_compact(F.array(F.when(F.coalesce(F.col("t.type"), F.lit("")) != "function", "TOOL_TYPE"), F.when(F.coalesce(F.trim("t.name"), F.lit("")) == "", "TOOL_NAME"), F.when(F.array_position("names", F.col("t.name")) - 1 < F.col("i"), "TOOL_NAME_DUPLICATE"), F.when(F.coalesce(kind, F.lit("")) != "object", "TOOL_PARAMETERS")))
    return d.select("key", F.col("t.name").alias("tool"), F.explode(codes).alias("code"))


def expired(times: DataFrame, now: Column) -> DataFrame:
    """``times(key, issued, expires)`` as ISO texts to ``(key, code)``: no dates, ended, or issued after their end."""
    a, b = F.try_to_timestamp("issued"), F.try_to_timestamp("expires")
    return broken(times, {"DATE_INVALID": a.isNull() | b.isNull(), "EXPIRED": F.coalesce(b <= now, F.lit(False)), "ISSUED_AFTER_EXPIRY": F.coalesce(a >= b, F.lit(False))})


def provider_request(examples: DataFrame, style: str = "chat") -> DataFrame:
    """``(example_id, system, messages)``: text parts joined; system messages joined by a blank line and apart (``split``) or as first turn (``chat``)."""
    ms = F.coalesce("messages", F.array())
    system = F.array_join(F.transform(F.filter(ms, lambda m: m["role"] == "system"), message_text), "\n\n")
    turns = F.transform(F.filter(ms, lambda m: m["role"] != "system"), lambda m: F.struct(F.when(m["role"] == "tool", "user").otherwise(m["role"]).alias("role"), message_text(m).alias("content")))
    if style == "split":
        return examples.select("example_id", F.nullif(system, F.lit("")).alias("system"), turns.alias("messages"))
    first = F.when(system != "", F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))).otherwise(F.array())
    return examples.select("example_id", F.lit(None).cast("string").alias("system"), F.concat(first, turns).alias("messages"))


def provider_response(replies: DataFrame) -> DataFrame:
    """Provider JSON ``(key, payload)`` of either form to ``(key, text, finish, input_tokens, output_tokens)``; text parts are joined."""
    j = lambda *paths: F.coalesce(*(F.get_json_object("payload", p) for p in paths))
    parts = F.from_json(F.get_json_object("payload", "$.content"), "array<struct<type: string, text: string>>")
    text = F.coalesce(F.get_json_object("payload", "$.choices[0].message.content"), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), ""))
    return replies.select("key", text.alias("text"), j("$.choices[0].finish_reason", "$.stop_reason").alias("finish"), j("$.usage.prompt_tokens", "$.usage.input_tokens").try_cast("long").alias("input_tokens"), j("$.usage.completion_tokens", "$.usage.output_tokens").try_cast("long").alias("output_tokens"))


def resolve_config(layers: DataFrame, order: tuple[str, ...] = ("cli", "env", "command", "default")) -> DataFrame:
    """``layers(layer, key, value)`` to each key's value in the first layer of ``order`` that has one: ``(key, value, layer)``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("layer"))
    return layers.filter((rank > 0) & F.col("value").isNotNull()).groupBy("key").agg(F.min_by("value", rank).alias("value"), F.min_by("layer", rank).alias("layer"))


def put_objects(store: DataFrame, puts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conditional writes: ``store(key, etag, content)`` and ``puts(key, expected, content)`` to the new store and the keys refused.

    A put is taken where ``expected`` is the stored etag, or null and the key is new; of several puts of a
    key the least content is taken. An etag is the content's hash.
    """
    one = puts.groupBy("key").agg(F.min(F.struct("content", "expected")).alias("p"), F.count(F.lit(1)).alias("n"))
    j = store.select("key", "etag", "content").join(one, "key", "full")
    ok = F.col("p").isNotNull() & F.col("p.expected").eqNullSafe(F.col("etag"))
    new = j.filter(ok | F.col("etag").isNotNull()).select("key", F.when(ok, F.sha2(F.col("p.content"), 256)).otherwise(F.col("etag")).alias("etag"), F.when(ok, F.col("p.content")).otherwise(F.col("content")).alias("content"))
    return new, j.filter(F.col("p").isNotNull() & (~ok | (F.col("n") > 1))).select("key", F.when(ok, "repeated").otherwise("conflict").alias("reason"))


def collated(df: DataFrame, c: str, name: str = "place", collation: str = "UNICODE") -> DataFrame:
    """``df`` with each row's place in dictionary order of a text column; ties by bytes. The column itself keeps its type."""
    return numbered(df, [F.collate(F.col(c), collation).asc(), F.col(c).asc()], name)


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


def _requests(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("payload"), F.pmod("o_orderkey", F.lit(700)).alias("runtime_s"), F.pmod("o_custkey", F.lit(2000)).alias("queue_s"), F.pmod("o_custkey", F.lit(5)).alias("min_workers"), F.pmod("o_orderkey", F.lit(4)).alias("max_workers"))
    return request_errors(o, 10)


def _provider(s: SparkSession, d: str) -> DataFrame:
    p = provider_request(table(s, d, "chat_examples"), "split")
    return p.select("example_id", F.length("system").alias("system_chars"), F.size("messages").alias("turns"), F.aggregate("messages", F.lit(0), lambda n, m: n + F.length(m["content"])).alias("chars"))


def _isolated(s: SparkSession, d: str) -> DataFrame:
    return isolated(_events(s, d).select(F.col("user_id").alias("prefix"), F.col("event_id").alias("attempt")))


QUERIES = {"serverless_request_errors": _requests, "provider_requests": _provider, "isolated_runs": _isolated}
_TEXT = "coalesce(array_to_string(list_transform(list_filter(m.content, lambda p: p.type = 'text'), lambda p: coalesce(p.text, '')), chr(10)), '')"
SQL = {
    "serverless_request_errors": """WITH r AS (SELECT o_orderkey AS key, o_orderkey % 700 AS r, o_custkey % 2000 AS q, o_custkey % 5 AS a, o_orderkey % 4 AS b FROM orders)
SELECT key, 'RUNTIME' AS code FROM r WHERE r NOT BETWEEN 1 AND 600 UNION ALL SELECT key, 'QUEUE_TTL' FROM r WHERE q NOT BETWEEN 1 AND 1800 UNION ALL SELECT key, 'SCALING' FROM r WHERE b < 1 OR a > b""",
    "provider_requests": f"""WITH t AS (SELECT example_id, list_transform(coalesce(messages, []), lambda m: {{'s': m.role = 'system', 't': {_TEXT}}}) AS t FROM chat_examples)
SELECT example_id, nullif(length(array_to_string(list_transform(list_filter(t, lambda x: x.s), lambda x: x.t), chr(10) || chr(10)))::INTEGER, 0) AS system_chars, len(list_filter(t, lambda x: NOT x.s))::INTEGER AS turns,
 coalesce(list_sum(list_transform(list_filter(t, lambda x: NOT x.s), lambda x: length(x.t))), 0)::INTEGER AS chars FROM t""",
    "isolated_runs": "SELECT 'prefix' AS what, user_id::VARCHAR AS value, count(*) AS times FROM events GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'attempt', event_id::VARCHAR, count(*) FROM events GROUP BY 2 HAVING count(*) > 1",
}
