import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import contracts, dedupe, distill, ledger, report
from corvane.plans.ranks import numbered
from corvane.plans.stages import run


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def codes(df):
    return sorted((r[0], r["code"]) for r in df.collect())


MESSAGES = "array<struct<role:string,content:array<struct<type:string,text:string,value:string,uri:string>>,name:string,toolCallId:string,toolCalls:array<struct<id:string,name:string,arguments:string>>>>"


def say(role, text):
    return (role, [("text", text, None, None)], None, None, None)


def test_chat_pipeline(spark, tmp_path):
    ex = [(f"r{i}", [say("user", f"question {i}")], "test" if i == 3 else None, None, None, (None, None, None)) for i in range(6)]
    rows(spark, ex, f"record string, messages {MESSAGES}, split string, group_id string, metadata string, provenance struct<source:string,sourceId:string,license:string>").write.parquet(f"{tmp_path}/in")
    answers = {"r0": "the first answer to it", "r1": "the first answer to it", "r2": "", "r4": "another one entirely here", "r5": "write to a@b.com about it"}

    def generate(p):
        a = F.try_element_at(F.create_map(*(F.lit(x) for kv in answers.items() for x in kv)), F.col("record"))
        part = F.struct(F.lit("text").alias("type"), a.alias("text"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("uri"))
        new = F.array(F.struct(F.lit("assistant").alias("role"), F.array(part).alias("content"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("toolCallId"), F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>").alias("toolCalls")))
        return p.select("record", F.concat("record", F.lit("-c")).alias("candidate"), F.concat("messages", new).alias("messages"))

    def judge(c):
        return c.select("candidate", F.when(F.col("record") == "r4", F.lit(float("nan"))).otherwise(0.9).alias("quality"))

    stages = distill.chat_pipeline(generate, "s", judge)
    stages[0].needs = ()
    stages[0].run = lambda: spark.read.parquet(f"{tmp_path}/in")
    out = run(spark, stages, f"file://{tmp_path}/run")
    table = lambda n: spark.read.parquet(out[n][0])
    assert sorted(r.record for r in table("responses").collect()) == ["r0", "r1", "r2", "r4", "r5"]  # r3 is held out
    bad = {(r.record, r.stage) for r in table("decisions").filter("outcome = 'rejected'").collect()}
    assert bad == {("r2", "verify"), ("r2", "filter"), ("r4", "judge"), ("r4", "filter")} and table("decisions").filter("outcome = 'review'").first().record == "r5"
    assert sorted(r.record for r in table("final").collect()) == ["r0", "r5"]  # r1 repeats r0
    assert all(reused for _, reused in run(spark, stages, f"file://{tmp_path}/run").values())


def test_embedding_pipeline(spark, tmp_path):
    t = [("a", "query-document", "train", "g1", "query", "q1", "where is the old mill"), ("a", "query-document", "train", "g1", "document", "d1", "the mill is by the river"), ("b", "query-document", "train", "g2", "query", "q2", "who opens the gate"), ("b", "query-document", "train", "g2", "document", "d2", "the guard opens it"),
         ("c", "query-document", "train", "g3", "document", "d3", "where is the old mill"), ("h", "query-document", "test", "g4", "document", "d4", "held out")]
    texts = rows(spark, t, "record_id string, kind string, split string, group string, text_role string, id string, text string")
    service = {
        "generate": lambda d: d.select(F.concat(F.lit("g-"), "document").alias("id"), F.concat(F.lit("about "), "text").alias("text"), "group", F.col("document").alias("source_document")), "verify": lambda g: g.withColumn("supported", F.col("source_document") != "d3"),
        "mine": lambda q, d: q.select("query_id").distinct().crossJoin(d.select("document").distinct()).withColumn("rank", F.lit(1)), "score": lambda p: p.filter("outcome = 'kept'").select("query_id", "document", F.lit(0.5).alias("score"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high")),
        "judge": lambda s: s.withColumn("accepted", F.col("document") != "d2"), "rank": lambda p: p.filter("outcome = 'kept'").groupBy("query_id").agg(F.sort_array(F.collect_list("document"), False).alias("ranking")), "embed": lambda x: x.select("id", F.array(F.lit(1.0)).alias("vector")),
    }
    stages = distill.embedding_pipeline(service)
    stages[0].needs = ()
    corpus = stages[0].run
    stages[0].run = lambda: corpus(texts)
    out = run(spark, stages, f"file://{tmp_path}/run")
    table = lambda n: spark.read.parquet(out[n][0])
    pool = {(r.query_id, r.document): r.outcome for r in table("pool").collect()}
    assert pool["q1", "d1"] == "positive" and pool["q1", "d2"] == "kept" and pool["q1", "d3"] == "near-duplicate" and pool["g-d1", "d1"] == "same-group" and ("g-d3", "d1") not in pool
    kinds = {(r.kind, r.query_id, r.document) for r in table("rows").collect()}
    assert ("teacher-score", "q2", "d1") in kinds and ("teacher-score", "q1", "d2") not in kinds and ("teacher-ranking", "q1", None) in kinds
    assert {r.id for r in table("vectors").collect()} == {"q1", "q2", "d1", "d2", "d3", "g-d1", "g-d2"}
    bad = distill.pool_errors(table("pool"), table("ranked").withColumn("ranking", F.array(F.lit("d9"))))
    assert {r.code for r in bad.collect()} == {"EMBED_RANKING_POOL"}


def test_evaluation_report(spark):
    scored = rows(spark, [(q, c, s) for q in (1, 2) for c, s in (("a", 0.9), ("b", 0.5), ("c", 0.1))], "query long, candidate string, score double")
    relevant = rows(spark, [(1, "a"), (2, "c")], "query long, candidate string")
    queries = rows(spark, [(1, "en", "on", 64, 20), (2, "de", None, 64, None)], "query long, language string, prompt string, dimension int, length int")
    sts = rows(spark, [(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)], "predicted double, expected double")
    cls = rows(spark, [("x", "x"), ("y", "x")], "predicted string, expected string")
    limits = rows(spark, [("mrr", "base", 0.5, None, None), ("nope", "base", None, None, None), ("pearson", "base", None, None, 0.1)], "metric string, baseline string, minimum double, maximum double, minimum_delta double")
    base = rows(spark, [("base", "pearson", 0.45)], "baseline string, metric string, value double")
    spec = {"version": "1.0.0", "run": "r", "dataset": "d1", "evaluator": "e1", "projection_split": "train", "bootstrap": {"seed": 1, "samples": 20}}
    got = report.evaluate_spec(spec, (scored, relevant, queries), sts, cls, cls, base, limits)
    assert got["metrics"]["mrr"] == round((1 + 1 / 3) / 2, 9) and got["metrics"]["pearson"] == 0.5 and got["metrics"]["accuracy"] == 0.5
    assert set(got["slices"]) == {"language:en", "language:de", "prompt:on", "dimension:64", "length:short"} and got["slices"]["language:en"]["mrr"] == 1
    assert got["regression"] == {"passed": False, "failures": ["nope", "pearson"]} and got["intervals"]["mrr"]["low"] <= got["intervals"]["mrr"]["high"]
    text = json.dumps(got)
    assert report.model_card(text)["datasetRevision"] == "d1"
    with pytest.raises(ValueError, match="TAMPER"):
        report.verify_report(text.replace("e1", "e2"))
    with pytest.raises(ValueError, match="LEDGER_LEAK:2"):
        report.evaluate_spec(spec, (scored, relevant, queries), ledgers=[rows(spark, [("2",)], "id string")])
    for bad in ({"version": "2"}, {"mteb": {"offline": False}}, {"canaries": 1}, {"projection_split": "test"}):
        with pytest.raises(ValueError):
            report.evaluate_spec(spec | bad)
    prefix = {r.pos: r.value for r in report.prefix_spearman(rows(spark, [(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 3.0, 2.0)], "pos int, predicted double, expected double")).collect()}
    assert prefix[1] == 0 and abs(prefix[2] - 1) < 1e-12 and abs(prefix[3] - 0.5) < 1e-12


def test_contract_rules(spark):
    ok = ("k", "available", "a" * 40, "h", "y", "y", True, False, None, "p", "mean", "right", "l2", [64], 64, True, "c", "search and sort", "search")
    schema = "key string, status string, commit string, license_sha256 string, dataset_rights string, teacher_rights string, split_groups boolean, remote_code boolean, reviewed_commit string, prompt string, pooling string, padding string, normalization string, safe_dimensions array<int>, dimension int, dependencies_compatible boolean, contamination_hash string, intended_use string, wanted_use string"
    bad = ("b", "no", "main", None, "", None, False, True, None, "unknown", "m", "r", "l", [32], 64, False, None, "x", "y")
    assert {k for k, _ in codes(contracts.preflight(rows(spark, [ok, bad], schema)))} == {"b"} and len(codes(contracts.preflight(rows(spark, [bad], schema)))) == 11
    t = rows(spark, [("a", [1, 2], [0.5, 0.25], 0.25), ("b", [1, 1], [0.5, 0.6], 0.0), ("n", None, None, None)], "key string, positions array<int>, probabilities array<double>, residual double")
    assert [c for c in codes(contracts.logit_target_errors(t)) if c[0] != "n"] == [("b", "LOGIT_MASS"), ("b", "LOGIT_POSITIONS")]
    f = rows(spark, [("a", [1.0], [1.0], None), ("b", [1.0], [1.0, 2.0], None), ("c", [1.0], [1.0, 2.0], [[0.5, 0.5]])], "key string, student array<double>, teacher array<double>, projection array<array<double>>")
    assert codes(contracts.feature_target_errors(f)) == [("b", "FEATURE_DIMENSIONS")]
    p = rows(spark, [("a", '[{"id":"1","name":"n","goal":"g"}]'), ("b", '[{"id":"1","name":"n","goal":"g"},{"id":"1","name":"","goal":"g"}]'), ("c", "no")], "key string, text string")
    assert [c for c in codes(contracts.persona_errors(p)) if c[0] != "c"] == [("b", "PERSONA_FIELDS"), ("b", "PERSONA_IDS")] and ("c", "PERSONA_JSON") in codes(contracts.persona_errors(p))
    tools = rows(spark, [("r", [("function", "f", '{"type":"object"}'), ("function", "f", '{"type":"array"}'), (None, " ", None)])], "key string, tools array<struct<type:string,name:string,parameters:string>>")
    assert sorted(r.code for r in contracts.tool_definition_errors(tools).collect()) == ["TOOL_NAME", "TOOL_NAME_DUPLICATE", "TOOL_PARAMETERS", "TOOL_PARAMETERS", "TOOL_TYPE"]
    m = rows(spark, [("a", {1: 2, 2: 3}), ("b", {1: 2, 2: 2}), ("c", {1: -1})], "key string, mapping map<int,int>")
    assert codes(contracts.vocabulary_errors(m)) == [("b", "VOCABULARY_NOT_ONE_TO_ONE"), ("c", "VOCABULARY_NEGATIVE")]
    c = contracts.module_coverage(rows(spark, [("a", ["x", "y"], ["y"]), ("b", [], [])], "key string, wanted array<string>, found array<string>")).collect()
    assert {r.key: (r.coverage, r.missing, r.ok) for r in c} == {"a": (0.5, ["x"], False), "b": (0.0, [], False)}
    e = rows(spark, [("a", "2024-01-01T00:00:00Z", "2030-01-01T00:00:00Z"), ("b", "2024-01-01T00:00:00Z", "2023-01-01T00:00:00Z"), ("c", "x", None)], "key string, issued string, expires string")
    assert codes(contracts.expired(e, F.lit("2025-01-01").cast("timestamp"))) == [("b", "EXPIRED"), ("b", "ISSUED_AFTER_EXPIRY"), ("c", "DATE_INVALID")]
    a = contracts.attestations(rows(spark, [("a", True, "y"), ("b", False, None)], "key string, rights boolean, owner string"), ("rights", "owner"))
    assert codes(a) == [("b", "MISSING:owner"), ("b", "MISSING:rights")]
    assert contracts.audit_tokenizer(rows(spark, [(True, True, None)], "round_trip boolean, has_generation boolean, prefix_stable boolean")).first()[1:] == (True, True, False)


def test_control_tables(spark):
    cfg = rows(spark, [("default", "k", "1"), ("env", "k", "2"), ("cli", "j", None), ("default", "j", "3"), ("odd", "z", "4")], "layer string, key string, value string")
    assert {r.key: (r.value, r.layer) for r in contracts.resolve_config(cfg).collect()} == {"k": ("2", "env"), "j": ("3", "default")}
    store = rows(spark, [("a", "e1", b"old")], "key string, etag string, content binary")
    new, refused = contracts.put_objects(store, rows(spark, [("a", "e1", b"new"), ("b", None, b"x"), ("c", "no", b"y")], "key string, expected string, content binary"))
    assert {r.key: bytes(r.content) for r in new.collect()} == {"a": b"new", "b": b"x"} and [tuple(r) for r in refused.collect()] == [("c", "conflict")]
    ev = rows(spark, [("l", 1, 0, "a", "acquire", 10), ("l", 2, 5, "b", "acquire", 10), ("l", 3, 6, "a", "renew", 10), ("l", 4, 20, "b", "acquire", 10), ("l", 5, 21, "a", "release", 0), ("l", 6, 22, "b", "release", 0)], "lock string, seq long, at long, owner string, action string, ttl long")
    assert [(r.granted, r.holder) for r in ledger.leases(ev).orderBy("seq").collect()] == [(True, "a"), (False, "a"), (True, "a"), (True, "b"), (False, "b"), (True, None)]
    import hashlib

    h = hashlib.sha256(b"\x00".join([b"s", b"1", b"yes", b"ann"])).hexdigest()
    rv = rows(spark, [("s", 1, "yes", "ann", None), ("s", 2, "no", "bob", h), ("s", 3, "no", "bob", "x")], "subject string, seq long, decision string, reviewer string, previous string")
    assert [tuple(r) for r in ledger.review_breaks(rv).collect()] == [("s", 3)]
    assert [r[0] for r in rows(spark, [(429,), (503,), (401,), (400,)], "s int").select(ledger.classify_failure(F.col("s"))).collect()] == ["rate-limited", "retryable", "credentials", "permanent"]
    words = rows(spark, [(w,) for w in ("b", "A", "a", "_x", "B")], "w string")
    assert [r.w for r in contracts.collated(words, "w").orderBy("place").collect()] == ["_x", "a", "A", "b", "B"]
    n = numbered(spark.range(0, 5000, 1, 7).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(900))), [F.col("v"), F.col("id")], "n").orderBy("n").collect()
    assert [r.n for r in n] == list(range(1, 5001)) and [(r.v, r.id) for r in n] == sorted((r.v, r.id) for r in n)
    reply = rows(spark, [("a", '{"choices":[{"message":{"content":"hi"},"finish_reason":"stop"}],"usage":{"prompt_tokens":3,"completion_tokens":1}}'), ("b", '{"content":[{"type":"text","text":"h"},{"type":"tool"},{"type":"text","text":"o"}],"stop_reason":"end","usage":{"input_tokens":2,"output_tokens":5}}'), ("c", None)], "key string, payload string")
    assert {r.key: tuple(r)[1:] for r in contracts.provider_response(reply).collect()} == {"a": ("hi", "stop", 3, 1), "b": ("ho", "end", 2, 5), "c": (None, None, None, None)}


def test_semantic_tier_and_benchmark(spark):
    t = rows(spark, [(1, "the red fox runs over the hill"), (2, "a crimson animal crosses a mound"), (3, "THE red  fox runs over the hill"), (4, "nothing alike"), (5, None)], "key long, text string")
    pairs = lambda x: spark.createDataFrame([(1, 2)], "a long, b long")
    assert {r.key: (r.leader, r.method) for r in dedupe.dedupe_texts(t, semantic=pairs).collect()} == {1: (1, None), 2: (1, "semantic"), 3: (1, "normalized"), 4: (4, None)}
    b = rows(spark, [(100, "The red fox runs over the hill"), (101, "the RED fox runs over the hill")], "key long, text string")
    assert {tuple(r) for r in dedupe.benchmark_exclusions(t, b).collect()} == {(1, 100, "benchmark", 1.0), (3, 100, "benchmark", 1.0)}
    u = distill.union_last(rows(spark, [("a", 1, "x"), ("b", 2, "y")], "id string, pos int, v string"), rows(spark, [("a", 1, "z"), ("c", 2, "w")], "id string, pos int, v string"))
    assert [(r.id, r.v) for r in u.orderBy("position").collect()] == [("a", "z"), ("b", "y"), ("c", "w")]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    from corvane.sources import jsonl

    text = "".join(f'{{"i": {i}, "s": "{"é" * (i % 50)}"}}\r\n' if i % 7 else "\n" for i in range(5000))
    (tmp_path / "a.jsonl").write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sorted((r.line, r.byte_offset, r.value) for r in jsonl.read_lines(spark, str(tmp_path / "a.jsonl")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want, at = [], 0
    for n, raw in enumerate(text.encode().split(b"\n"), 1):
        if raw.strip():
            want.append((n, at, raw.decode().rstrip("\r")))
        at += len(raw) + 1
    assert got == want
