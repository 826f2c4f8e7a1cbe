"""Data-shaped parts of training: templates, collation, loss metrics, reference fits, contracts, synthetic conversations."""

from __future__ import annotations

import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.canonical import write_json


def instruct(task: Column, query: Column, prefix: str = "Instruct: {task}\nQuery: ") -> Column:
    """Query with its task in the prefix."""
    return F.concat(F.replace(F.lit(prefix), F.lit("{task}"), task), query)


def mask_labels(ids: Column, spans: Column, ignore: int = -100) -> Column:
    """Token ids where a span ``(start, stop)`` covers them, ``ignore`` elsewhere."""
    return F.transform(ids, lambda t, i: F.when(F.exists(spans, lambda s: (i >= s["start"]) & (i < s["stop"])), t).otherwise(F.lit(ignore)))


def pad(c: Column, width: Column, value: int) -> Column:
    """An array padded to a width."""
    return F.concat(c, F.array_repeat(F.lit(value), F.greatest(width - F.size(c), F.lit(0)).cast("int")))


def collate(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """``rows(batch, ids, labels)`` padded to their batch's greatest width, with an attention mask."""
    w = rows.groupBy(batch).agg(F.max(F.size("ids")).alias("width"))
    d = rows.join(w, batch)
    return d.select(batch, pad(F.col("ids"), F.col("width"), 0).alias("ids"), pad(F.col("labels"), F.col("width"), -100).alias("labels"), pad(F.transform("ids", lambda _: F.lit(1)), F.col("width"), 0).alias("mask"))


def contrastive_loss(pairs: DataFrame, dims: tuple[int, ...] = (8,), temperature: float = 0.05) -> DataFrame:
    """In-batch softmax loss of ``pairs(batch, i, q array, d array)`` for each leading number of dimensions; batches are of the trainer's size."""
    out = None
    for n in dims:
        cut = pairs.select("batch", "i", F.slice("q", 1, n).alias("q"), F.slice("d", 1, n).alias("d"))
        j = cut.select("batch", F.col("i").alias("a"), "q").join(cut.select("batch", F.col("i").alias("b"), "d"), "batch")
        from corvane.functions.text import cosine

        s = j.select("batch", "a", "b", (cosine(F.col("q"), F.col("d")) / temperature).alias("s"))
        m = s.groupBy("batch", "a").agg((F.max("s") + F.log(F.sum(F.exp(F.col("s") - 1 / temperature))) - F.max("s") + 1 / temperature - F.max(F.when(F.col("a") == F.col("b"), F.col("s")))).alias("loss"))
        r = m.agg(F.lit(n).alias("dims"), F.avg("loss").alias("loss"))
        out = r if out is None else out.unionByName(r)
    return out


def record_losses(rows: DataFrame) -> DataFrame:
    """Mean loss by kind of ``rows(kind, target, predicted)``: squared error, clipped cross entropy, absolute error."""
    t, p = F.col("target"), F.col("predicted")
    loss = F.when(F.col("kind") == "mse", F.pow(t - p, F.lit(2.0))).when(F.col("kind") == "cross-entropy", -t * F.log(F.greatest(F.lit(1e-12), p))).otherwise(F.abs(t - p))
    return rows.groupBy("kind").agg(F.round(F.avg(loss), 9).alias("loss"))


def featurize(text: Column) -> tuple[Column, Column]:
    """Two reproducible numbers of a text: its hash modulo 1000 over 1000, its length up to 100 over 100."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long"), F.lit(1000)) / 1000, F.least(F.lit(1.0), F.length(text) / 100)


def fit_weight(rows: DataFrame, rate: float = 0.1, momentum: float = 0.9, every: int = 0) -> DataFrame:
    """Momentum descent of one weight over ``rows(run, pos, x, y)`` in order: ``(run, step, weight)``; each run is one ordered fold."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w = v = 0.0
        out = []
        pdf = pdf.sort_values("pos")
        for step, (x, y) in enumerate(zip(pdf["x"], pdf["y"], strict=True), 1):
            v = momentum * v - rate * 2 * (w * x - y) * x
            w += v
            if (every and step % every == 0) or step == len(pdf):
                out.append((pdf["run"].iloc[0], step, w))
        return pd.DataFrame(out, columns=["run", "step", "weight"])

    return rows.groupBy("run").applyInPandas(one, "run string, step long, weight double")


def classify_checkpoint(c: dict[str, Column]) -> Column:
    """missing, corrupt, incompatible, weights-only or full-resume, from columns exists, intact, same_identity, has_optimizer."""
    return F.when(~c["exists"], "missing").when(~c["intact"], "corrupt").when(~c["same_identity"], "incompatible").when(~c["has_optimizer"], "weights-only").otherwise("full-resume")


def contract_errors(rows: DataFrame, required: dict[str, str], key: str = "key") -> DataFrame:
    """``(key, field)`` of JSON ``spec`` columns that miss a required field or do not match its pattern."""
    checks = F.array(*(F.when(~F.coalesce(F.get_json_object("spec", f"$.{k}").rlike(p), F.lit(False)), F.lit(k)) for k, p in required.items()))
    return rows.select(key, F.explode(F.array_compact(checks)).alias("field"))


def lora_targets(names: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Module names that end in a suffix, sorted."""
    return names.filter(F.regexp_extract("name", r"([^.]+)$", 1).isin(*suffixes)).select("name").distinct().orderBy("name")


def identity_hash(spec: dict) -> str:
    """SHA-256 of a specification's canonical JSON."""
    import hashlib

    return hashlib.sha256(write_json(spec).encode()).hexdigest()


def uuid7(ms: int | None = None) -> str:
    """A time-ordered unique id."""
    t = int(time.time() * 1000) if ms is None else ms
    r = uuid.uuid4().int
    return str(uuid.UUID(int=(t & ((1 << 48) - 1)) << 80 | 7 << 76 | (r >> 64 & 0xFFF) << 64 | 2 << 62 | r & ((1 << 62) - 1)))


def sample_value(schema: dict) -> object:
    """A value that fits a JSON schema."""
    kind = schema.get("type")
    if schema.get("enum"):
        return schema["enum"][0]
    if kind == "object":
        return {k: sample_value(s) for k, s in (schema.get("properties") or {}).items() if k in (schema.get("required") or schema.get("properties"))}
    return {"array": [], "string": "sample", "number": 1, "integer": 1, "boolean": True}.get(kind)


def personas(spark: SparkSession, bundled: list[dict], goals: list[str], count: int) -> DataFrame:
    """``count`` personas ``(id, name, goal)``: the bundled ones first, then numbered ones with goals in turn."""
    if count < 1:
        raise ValueError("count must be positive")
    rows = spark.range(count)
    names = F.array(*(F.lit(b["name"]) for b in bundled)) if bundled else F.array().cast("array<string>")
    own = F.array(*(F.lit(b["goal"]) for b in bundled)) if bundled else F.array().cast("array<string>")
    turn = F.element_at(F.array(*map(F.lit, goals)), (F.pmod("id", F.lit(len(goals))) + 1).cast("int"))
    return rows.select(F.format_string("persona-%04d", F.col("id") + 1).alias("id"), F.coalesce(F.get(names, F.col("id").cast("int")), F.format_string("Persona %d", F.col("id") + 1)).alias("name"), F.coalesce(F.get(own, F.col("id").cast("int")), turn).alias("goal"))


def trajectories(people: DataFrame, tools: list[dict]) -> DataFrame:
    """A deterministic conversation of each persona with a tool in turn: ``(example_id, messages)``."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long") - 1
    pick = lambda f: F.element_at(F.array(*(F.lit(f(t)) for t in tools)), (F.pmod(n, F.lit(len(tools))) + 1).cast("int"))
    name, args = pick(lambda t: t["name"]), pick(lambda t: write_json(sample_value(t["parameters"])))
    msg = lambda role, text, call=None, calls=None: F.struct(F.lit(role).alias("role"), text.alias("content"), (call if call is not None else F.lit(None).cast("string")).alias("tool_call_id"), (calls if calls is not None else F.array().cast("array<struct<id:string,name:string,arguments:string>>")).alias("tool_calls"))
    call = F.concat(F.lit("call-"), F.col("id"))
    return people.select(
        F.concat(F.lit("trajectory-"), F.col("id")).alias("example_id"),
        F.array(msg("user", F.col("goal")), msg("assistant", F.lit(None).cast("string"), None, F.array(F.struct(call.alias("id"), name.alias("name"), args.alias("arguments")))), msg("tool", F.lit('{"ok":true}'), call), msg("assistant", F.concat(F.lit("Done: "), F.col("goal")))).alias("messages"),
    )


def softmax(x: list[float]) -> list[float]:
    """Probabilities of logits."""
    e = np.exp(np.asarray(x, float) - max(x))
    return (e / e.sum()).tolist()
