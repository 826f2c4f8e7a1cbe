"""Conversations: staged validation, summaries, export modes, codecs, translation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.canonical import json_schema_errors
from corvane.functions.text import trim_all
from corvane.session import table

SCHEMA_VERSION = "1.0.0"


def _calls(m: Column) -> Column:
    return F.coalesce(m["toolCalls"], F.array())


def _content(m: Column) -> Column:
    return F.coalesce(m["content"], F.array())


def message_text(m: Column) -> Column:
    """A message's text parts joined by line ends."""
    return F.array_join(F.transform(F.filter(_content(m), lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def example_issues(examples: DataFrame) -> DataFrame:
    """``examples`` with ``issues array<struct<code, stage, path>>``, in one pass over each row.

    Schema: version, no messages. Semantic: a message without content and calls, a call id used
    again, a tool result without an earlier call, a call without a result. Training readiness:
    no assistant message with content or calls. Null messages count as none.
    """
    ms = F.coalesce("messages", F.array())

    def issue(code: str, stage: str, path: Column | str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(stage).alias("stage"), (F.lit(path) if isinstance(path, str) else path).alias("path"))

    def at(i: Column, field: str) -> Column:
        return F.concat(F.lit("messages["), i.cast("string"), F.lit(f"].{field}"))

    calls = F.flatten(F.transform(ms, lambda m, i: F.transform(_calls(m), lambda c: F.struct(c["id"].alias("id"), i.alias("i")))))
    results = F.filter(F.transform(ms, lambda m, i: F.struct(m["role"].alias("role"), m["toolCallId"].alias("id"), i.alias("i"))), lambda x: (x["role"] == "tool") & (F.coalesce(x["id"], F.lit("")) != ""))
    d = examples.withColumn("_calls", calls).withColumn("_results", results)
    c, r = F.col("_calls"), F.col("_results")
    empty = F.transform(F.filter(F.transform(ms, lambda m, i: F.struct((F.size(_content(m)) + F.size(_calls(m))).alias("n"), i.alias("i"))), lambda x: x["n"] == 0), lambda x: issue("CONTENT_EMPTY", "semantic", at(x["i"], "content")))
    again = F.transform(F.filter(F.transform(c, lambda x, k: F.struct(x["i"].alias("i"), (F.array_position(F.transform(c, lambda y: y["id"]), x["id"]) - 1 < k).alias("dup"))), lambda x: x["dup"]), lambda x: issue("TOOL_CALL_ID_DUPLICATE", "semantic", at(x["i"], "toolCalls")))
    orphan = F.transform(F.filter(r, lambda x: ~F.exists(c, lambda y: (y["id"] == x["id"]) & (y["i"] <= x["i"]))), lambda x: issue("TOOL_RESULT_ORPHANED", "semantic", at(x["i"], "toolCallId")))
    missing = F.transform(F.array_except(F.transform(c, lambda x: x["id"]), F.transform(r, lambda x: x["id"])), lambda _: issue("TOOL_RESULT_MISSING", "semantic", "messages"))
    target = F.exists(ms, lambda m: (m["role"] == "assistant") & (F.size(_content(m)) + F.size(_calls(m)) > 0))
    none = F.filter(F.array(issue("", "", "")), lambda _: F.lit(False))
    one = lambda bad, *a: F.when(bad, F.array(issue(*a))).otherwise(none)
    issues = F.concat(
        one(F.coalesce(F.col("dataset_schema_version"), F.lit("")) != SCHEMA_VERSION, "SCHEMA_VERSION_UNSUPPORTED", "schema", "datasetSchemaVersion"),
        one(F.size(ms) == 0, "MESSAGES_EMPTY", "schema", "messages"), empty, again, orphan, missing,
        one(~target, "ASSISTANT_TARGET_MISSING", "training-readiness", "messages"),
    )
    return d.withColumn("issues", issues).drop("_calls", "_results")


def stages(issues: Column) -> dict[str, Column]:
    """Whether each stage is without issues."""
    def clean(stage: str) -> Column:
        return ~F.exists(issues, lambda x: x["stage"] == stage)

    return {s: clean(s) for s in ("schema", "semantic", "training-readiness")}


def dataset_summary(examples: DataFrame) -> DataFrame:
    """Rows, valid and invalid ones, messages, calls, results, rows with calls, messages a row."""
    d = example_issues(examples)
    ms = F.coalesce("messages", F.array())
    calls = F.aggregate(ms, F.lit(0), lambda n, m: n + F.size(_calls(m)))
    results = F.size(F.filter(ms, lambda m: m["role"] == "tool"))
    return d.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.size("issues") == 0).alias("valid"), F.count_if(F.size("issues") > 0).alias("invalid"), F.sum(F.size(ms)).alias("messages"),
        F.sum(calls).alias("tool_calls"), F.sum(results).alias("tool_results"), F.count_if(calls > 0).alias("rows_with_tools"),
        F.round(F.sum(F.size(ms)).cast("double") / F.count(F.lit(1)), 6).alias("avg_messages"),
    )


def select_messages(mode: str) -> Column:
    """Messages of an export mode: plain_chat (no tool traffic), tool_decision (to the first call), full_tool_trajectory."""
    ms = F.coalesce("messages", F.array())
    if mode == "plain_chat":
        return F.filter(ms, lambda m: (m["role"] != "tool") & (F.size(_calls(m)) == 0))
    if mode == "tool_decision":
        first = F.array_position(F.transform(ms, lambda m: F.size(_calls(m)) > 0), True)
        return F.when(first > 0, F.slice(ms, F.lit(1), first.cast("int"))).otherwise(ms)
    if mode == "full_tool_trajectory":
        return ms
    raise ValueError(f"unknown export mode {mode}")


def include_tools(policy: str) -> Column:
    """Whether a row carries tool definitions: always, never, or (auto) if a message calls one."""
    if policy in ("always", "never"):
        return F.lit(policy == "always")
    return F.exists(F.coalesce("messages", F.array()), lambda m: F.size(_calls(m)) > 0)


def to_chat_rows(examples: DataFrame, mode: str = "full_tool_trajectory") -> DataFrame:
    """Chat fine-tuning rows ``(example_id, messages, losses)``: role, content, tool_calls, tool_call_id, name.

    A message whose content is not exactly one text part loses the others (``CONTENT_PARTS_UNSUPPORTED``).
    """
    ms = select_messages(mode)
    text = lambda m: F.when((F.size(_content(m)) > 0), message_text(m))
    calls = lambda m: F.transform(_calls(m), lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
    rows = F.transform(ms, lambda m: F.struct(m["role"].alias("role"), text(m).alias("content"), calls(m).alias("tool_calls"), m["toolCallId"].alias("tool_call_id"), m["name"].alias("name")))
    return examples.select("example_id", rows.alias("messages"), _part_losses(ms).alias("losses"))


def _part_losses(ms: Column) -> Column:
    def ok(m: Column) -> Column:
        return (F.size(_content(m)) == 0) | ((F.size(_content(m)) == 1) & F.forall(_content(m), lambda p: F.coalesce(p["type"], F.lit("")) == "text"))

    marked = F.transform(ms, lambda m, i: F.struct(ok(m).alias("ok"), F.struct(F.lit("CONTENT_PARTS_UNSUPPORTED").alias("code"), i.alias("msg_idx")).alias("loss")))
    return F.transform(F.filter(marked, lambda x: ~x["ok"]), lambda x: x["loss"])


def to_conversational(examples: DataFrame) -> DataFrame:
    """Role and content only; what is lost is named: calls (``HF_TOOL_SEMANTICS_UNSUPPORTED``) once a row."""
    ms = F.coalesce("messages", F.array())
    rows = F.transform(ms, lambda m: F.struct(m["role"].alias("role"), message_text(m).alias("content")))
    tools = F.exists(ms, lambda m: (F.size(_calls(m)) > 0) | (m["role"] == "tool"))
    return examples.select("example_id", rows.alias("messages"), F.when(tools, F.array(F.lit("HF_TOOL_SEMANTICS_UNSUPPORTED"))).otherwise(F.array().cast("array<string>")).alias("losses"))


def to_text(examples: DataFrame) -> DataFrame:
    """``role: text`` lines of a conversation."""
    return examples.select("example_id", F.array_join(F.transform(F.coalesce("messages", F.array()), lambda m: F.concat(m["role"], F.lit(": "), message_text(m))), "\n").alias("text"))


def from_chat_rows(rows: DataFrame) -> DataFrame:
    """Canonical messages of chat rows: each content string becomes one text part, calls keep id, name and arguments."""
    part = lambda c: F.when(c.isNotNull(), F.array(F.struct(F.lit("text").alias("type"), c.alias("text"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("uri"))))
    calls = lambda m: F.transform(F.coalesce(m["tool_calls"], F.array()), lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments")))
    return rows.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), part(m["content"]).alias("content"), m["name"].alias("name"), m["tool_call_id"].alias("toolCallId"), calls(m).alias("toolCalls"))))


def prompts(examples: DataFrame) -> DataFrame:
    """Generation requests: messages before the last assistant one (tool results as user turns), and that answer."""
    ms = F.coalesce("messages", F.array())
    last = F.size(ms) - F.array_position(F.reverse(F.transform(ms, lambda m: m["role"] == "assistant")), True)
    has = F.exists(ms, lambda m: m["role"] == "assistant")
    flat = F.transform(F.slice(ms, F.lit(1), F.greatest(last, F.lit(0)).cast("int")), lambda m: F.concat(F.when(m["role"] == "tool", "user").otherwise(m["role"]), F.lit(": "), message_text(m)))
    return examples.filter(has).select("example_id", F.array_join(flat, "\n").alias("prompt"), message_text(F.element_at(ms, (last + 1).cast("int"))).alias("answer"))


def translate(examples: DataFrame, locale: str, how: Callable[[Column], Column] | None = None) -> DataFrame:
    """Translate system, user and assistant text; tool results, calls and all else stay. The default marks the locale only."""
    say = how or (lambda t: F.concat(F.lit(f"[{locale}] "), t))
    part = lambda p, yes: p.withField("text", F.when(yes & (p["type"] == "text") & p["text"].isNotNull(), say(p["text"])).otherwise(p["text"]))
    return examples.withColumn("messages", F.transform("messages", lambda m: m.withField("content", F.transform(m["content"], lambda p: part(p, m["role"].isin("system", "user", "assistant")))))).withColumn("locale", F.lit(locale))


def untouched(before: Column, after: Column) -> Column:
    """Whether a translation kept roles, names, ids and calls."""
    bare = lambda c: F.to_json(F.transform(c, lambda m: F.struct(m["role"], m["name"], m["toolCallId"], m["toolCalls"])))
    return bare(before).eqNullSafe(bare(after))


def valid_locale(c: Column) -> Column:
    """Well-formed language tag (language, script, region, variants)."""
    return c.rlike(r"^[A-Za-z]{2,8}(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?(-([A-Za-z0-9]{5,8}|[0-9][A-Za-z0-9]{3}))*$")


def bad_translation(c: Column) -> Column:
    """Blank, fenced, wrapped in quotes or in JSON."""
    t = trim_all(c)
    return (t == "") | t.rlike("(?s)^```.*```$") | t.rlike(r'(?s)^(".*"|\'.*\'|“.*”)$') | (t.rlike(r"(?s)^[\[{].*[\]}]$") & F.try_parse_json(t).isNotNull())


def detect_format(keys: Column) -> Column:
    """Codec of a row by its field names, the first of equal score."""
    has = lambda *k: F.forall(F.array(*map(F.lit, k)), lambda x: F.array_contains(keys, x))
    return F.when(has("datasetSchemaVersion", "messages"), "canonical-messages").when(has("messages"), "openai-chat").when(has("text"), "hf-text")


def call_argument_errors(examples: DataFrame, schemas: DataFrame) -> DataFrame:
    """Arguments of every call against ``schemas(name, parameters)``: ``(example_id, call_id, path, message)``.

    Schemas are few (one a tool) and reach the calls by broadcast.
    """
    c = examples.select("example_id", F.explode("messages").alias("m")).select("example_id", F.explode("m.toolCalls").alias("c")).select("example_id", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    return c.join(F.broadcast(schemas), "name").select("example_id", "call_id", F.explode(json_schema_errors("arguments", "parameters")).alias("e")).select("example_id", "call_id", "e.path", "e.message")


def _chat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_examples")


def _issue_rows(spark: SparkSession, d: str) -> DataFrame:
    return example_issues(_chat(spark, d)).select("example_id", F.explode("issues").alias("x")).select("example_id", "x.code", "x.stage", "x.path")


def _prefix(spark: SparkSession, d: str) -> DataFrame:
    return _chat(spark, d).select("example_id", F.size(select_messages("tool_decision")).alias("prefix"), F.size(select_messages("plain_chat")).alias("plain"), include_tools("auto").alias("tools"))


QUERIES = {
    "chat_dataset_summary": lambda s, d: dataset_summary(_chat(s, d)),
    "chat_locale_counts": lambda s, d: _chat(s, d).groupBy(F.coalesce("locale", F.lit("unknown")).alias("locale")).agg(F.count(F.lit(1)).alias("rows")),
    "chat_row_issues": _issue_rows,
    "chat_stage_counts": lambda s, d: example_issues(_chat(s, d)).agg(*(F.count_if(c).alias(k.replace("-", "_")) for k, c in stages(F.col("issues")).items())),
    "chat_export_modes": _prefix,
    "chat_openai_losses": lambda s, d: to_chat_rows(_chat(s, d)).select("example_id", F.explode("losses").alias("x")).select("example_id", "x.code", "x.msg_idx"),
    "chat_hf_conversational": lambda s, d: to_conversational(_chat(s, d)).select("example_id", F.size("messages").alias("messages"), F.array_join("losses", ",").alias("losses")),
    "chat_text_render": lambda s, d: to_text(_chat(s, d)),
    "chat_training_prompts": lambda s, d: prompts(_chat(s, d)),
    "chat_pseudo_translate": lambda s, d: to_text(translate(_chat(s, d), "xx")),
    "chat_round_trip": lambda s, d: from_chat_rows(to_chat_rows(_chat(s, d))).select("example_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), message_text(m))), "\n").alias("text")),
}

_MESSAGES = """
r AS (SELECT row_number() OVER () AS rid, * FROM chat_examples),
m AS (SELECT rid, example_id, generate_subscripts(messages, 1) - 1 AS i, unnest(messages) AS m FROM r),
c AS (SELECT rid, example_id, i, generate_subscripts(m.toolCalls, 1) AS k, unnest(m.toolCalls).id AS id FROM m)
"""
_ISSUES = f"""
{_MESSAGES},
e AS (
  SELECT rid, example_id, 'SCHEMA_VERSION_UNSUPPORTED' AS code, 'schema' AS stage, 'datasetSchemaVersion' AS path FROM r WHERE coalesce(dataset_schema_version, '') <> '1.0.0'
  UNION ALL SELECT rid, example_id, 'MESSAGES_EMPTY', 'schema', 'messages' FROM r WHERE coalesce(len(messages), 0) = 0
  UNION ALL SELECT rid, example_id, 'CONTENT_EMPTY', 'semantic', 'messages[' || i || '].content' FROM m WHERE coalesce(len(m.content), 0) = 0 AND coalesce(len(m.toolCalls), 0) = 0
  UNION ALL SELECT rid, example_id, 'TOOL_CALL_ID_DUPLICATE', 'semantic', 'messages[' || i || '].toolCalls' FROM (SELECT *, row_number() OVER (PARTITION BY rid, id ORDER BY i, k) AS n FROM c) WHERE n > 1
  UNION ALL SELECT rid, example_id, 'TOOL_RESULT_ORPHANED', 'semantic', 'messages[' || i || '].toolCallId' FROM m
    WHERE m.role = 'tool' AND coalesce(m.toolCallId, '') <> '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.rid = m.rid AND c.id = m.m.toolCallId AND c.i <= m.i)
  UNION ALL SELECT rid, example_id, 'TOOL_RESULT_MISSING', 'semantic', 'messages' FROM (SELECT DISTINCT rid, example_id, id FROM c) d
    WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.rid = d.rid AND m.m.role = 'tool' AND m.m.toolCallId = d.id)
  UNION ALL SELECT rid, example_id, 'ASSISTANT_TARGET_MISSING', 'training-readiness', 'messages' FROM r
    WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.rid = r.rid AND m.m.role = 'assistant' AND coalesce(len(m.m.content), 0) + coalesce(len(m.m.toolCalls), 0) > 0)
)
"""
_TEXT = "coalesce(array_to_string(list_transform(list_filter(m.content, lambda p: p.type = 'text'), lambda p: coalesce(p.text, '')), chr(10)), '')"
_JOINED = f"SELECT example_id, coalesce(array_to_string(list_transform(messages, lambda m: m.role || ': ' || {_TEXT}), chr(10)), '') AS text FROM chat_examples"
SQL = {
    "chat_dataset_summary": f"""WITH {_ISSUES}
SELECT (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM r WHERE rid NOT IN (SELECT rid FROM e)) AS valid, (SELECT count(DISTINCT rid) FROM e) AS invalid,
  (SELECT count(*) FROM m) AS messages, (SELECT count(*) FROM c) AS tool_calls, (SELECT count(*) FROM m WHERE m.role = 'tool') AS tool_results,
  (SELECT count(DISTINCT rid) FROM c) AS rows_with_tools, round((SELECT count(*) FROM m)::DOUBLE / (SELECT count(*) FROM r), 6) AS avg_messages""",
    "chat_locale_counts": "SELECT coalesce(locale, 'unknown') AS locale, count(*) AS rows FROM chat_examples GROUP BY 1",
    "chat_row_issues": f"WITH {_ISSUES} SELECT example_id, code, stage, path FROM e",
    "chat_stage_counts": f"""WITH {_ISSUES} SELECT count(*) FILTER (WHERE rid NOT IN (SELECT rid FROM e WHERE stage = 'schema')) AS schema,
  count(*) FILTER (WHERE rid NOT IN (SELECT rid FROM e WHERE stage = 'semantic')) AS semantic,
  count(*) FILTER (WHERE rid NOT IN (SELECT rid FROM e WHERE stage = 'training-readiness')) AS training_readiness FROM r""",
    "chat_export_modes": f"""WITH {_MESSAGES}
SELECT r.example_id, coalesce((SELECT min(i) + 1 FROM c WHERE c.rid = r.rid), coalesce(len(messages), 0))::INTEGER AS prefix,
  (SELECT count(*) FROM m WHERE m.rid = r.rid AND m.m.role <> 'tool' AND coalesce(len(m.m.toolCalls), 0) = 0)::INTEGER AS plain,
  EXISTS (SELECT 1 FROM c WHERE c.rid = r.rid) AS tools FROM r""",
    "chat_openai_losses": f"""WITH {_MESSAGES} SELECT example_id, 'CONTENT_PARTS_UNSUPPORTED' AS code, i::INTEGER AS msg_idx FROM m
WHERE len(m.content) > 1 OR (len(m.content) = 1 AND coalesce(m.content[1].type, '') <> 'text')""",
    "chat_hf_conversational": """SELECT example_id, coalesce(len(messages), 0)::INTEGER AS messages,
  CASE WHEN len(list_filter(messages, lambda m: m.role = 'tool' OR len(m.toolCalls) > 0)) > 0 THEN 'HF_TOOL_SEMANTICS_UNSUPPORTED' ELSE '' END AS losses FROM chat_examples""",
    "chat_text_render": _JOINED,
    "chat_training_prompts": f"""WITH {_MESSAGES}, l AS (SELECT rid, example_id, max(i) AS last FROM m WHERE m.role = 'assistant' GROUP BY ALL)
SELECT l.example_id, coalesce(string_agg(CASE WHEN i < last THEN (CASE WHEN m.m.role = 'tool' THEN 'user' ELSE m.m.role END) || ': ' || {_TEXT.replace("m.content", "m.m.content")} END, chr(10) ORDER BY i), '') AS prompt,
  max(CASE WHEN i = last THEN {_TEXT.replace("m.content", "m.m.content")} END) AS answer FROM l JOIN m USING (rid) GROUP BY l.rid, l.example_id""",
    "chat_pseudo_translate": _JOINED.replace("coalesce(p.text, '')", "coalesce(CASE WHEN m.role IN ('system', 'user', 'assistant') THEN '[xx] ' || p.text ELSE p.text END, '')"),
    "chat_round_trip": _JOINED,
}
