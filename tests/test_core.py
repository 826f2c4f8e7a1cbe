import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions import canonical, text
from corvane.operators import dedupe, evaluate, ledger, training
from corvane.operators.components import connected_components
from corvane.plans.cut import cut, drop
from corvane.plans.stages import Stage, order, run
from corvane.sources import frozen, jsonl


def pairs(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_components_against_union_find(spark):
    r = random.Random(3)
    rows = [(f"r{r.randrange(300):03}", f"k{r.randrange(260)}") for _ in range(420)] + [(f"chain{i:03}", f"c{j}") for i in range(60) for j in (i, i + 1)] + [("lone", None), ("lone2", " "), (None, "c1")]
    rows += [(f"hub{i:04}", "hub") for i in range(1500)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, k in rows:
        if a is None:
            continue
        find(("r", a))
        if k and k.strip():
            parent[find(("r", a))] = find(("k", k))
    groups = {}
    for a, _ in rows:
        if a is not None:
            groups.setdefault(find(("r", a)), set()).add(a)
    want = {a: min(g) for g in groups.values() for a in g}
    got = connected_components(pairs(spark, rows, "record string, key string"))
    assert {x.record: x.component for x in got.collect()} == want
    assert connected_components(pairs(spark, [], "record string, key string")).count() == 0


def test_lineage_keys_of_texts_and_time(spark, tmp_path):
    from corvane.queries import queries

    meta = {"a": '{"timeGroup": "t"}', "b": '{"timeGroup": "t"}', "c": '{"timeGroup": 5}', "d": '{"timeGroup": 5}', "e": "{broken", "g": None}
    rec = [(r, f"s{r}", None, None, None, None, m) for r, m in meta.items()]
    texts = [("c", "hot", None, ""), ("e", "hot", None, None), ("d", None, "doc", None), ("g", None, "other", "doc"), ("gone", "hot", "doc", None)]
    pairs(spark, rec, "record_id string, split_group string, parent_group string, translation_group string, synthetic_group string, source_id string, metadata string").write.parquet(f"{tmp_path}/embedding_records.parquet")
    pairs(spark, texts, "record_id string, entity_id string, document_id string, corpus_id string").write.parquet(f"{tmp_path}/embedding_texts.parquet")
    got = {r.record_id: r.component for r in queries()["lineage_components_whole"](spark, str(tmp_path)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "e": "c", "d": "d", "g": "d"}


def test_triplets_keep_their_negative(spark):
    from corvane.operators.records import decode_rows

    rows = [{"anchor": "a", "positive": "p", "negative": "n"}, {"query": "a", "positive": "p", "negative": " "}, {"query": "q", "document": "d", "note": "x"}, {"query": "q", "positives": ["p"]}]
    d = pairs(spark, [(i, json.dumps(r | {"split_group": "g"})) for i, r in enumerate(rows)], "key int, payload string")
    got = {r.key: (r.task, r.query, r.document, r.negative, r.error) for r in decode_rows(d).collect()}
    assert got == {0: ("triplet", "a", "p", "n", None), 1: (None, None, None, None, "EMBED_TEXT_REQUIRED"), 2: ("pair", "q", "d", None, None), 3: (None, None, None, None, "EMBED_TEXT_REQUIRED")}


def test_leaders_differ_from_components(spark):
    keys = pairs(spark, [(i,) for i in (1, 2, 3, 4, 5)], "key long")
    edges = pairs(spark, [(1, 2), (2, 3), (3, 4)], "a long, b long")  # 1~2~3~4 but 1 and 3 are not similar
    got = {r.key: r.leader for r in dedupe.leader_clusters(keys, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_leader_clusters_random(spark):
    r = random.Random(5)
    n = 60
    e = {(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.05}
    leader = {}
    for i in range(n):
        own = [j for j in range(i) if leader[j] == j and (j, i) in e]
        leader[i] = min(own, default=i)
    got = dedupe.leader_clusters(pairs(spark, [(i,) for i in range(n)], "key long"), pairs(spark, sorted(e), "a long, b long"))
    assert {x.key: x.leader for x in got.collect()} == leader


def test_similar_pairs_brute_force(spark):
    r = random.Random(1)
    sets = [(i, [str(x) for x in r.sample(range(14), r.randrange(0, 9))]) for i in range(80)] + [(900, None)]
    want = set()
    for a, x in sets[:80]:
        for b, y in sets[:80]:
            x_, y_ = set(x), set(y)
            if a < b and x_ and y_ and len(x_ & y_) / len(x_ | y_) >= 0.6:
                want.add((a, b))
    got = dedupe.similar_pairs(pairs(spark, sets, "key long, items array<string>"), 0.6)
    assert {(x.a, x.b) for x in got.collect()} == want


def test_text_dedupe_goldens(spark):
    d = pairs(spark, [("a", "Hello   WORLD"), ("b", "hello world"), ("c", "one two three four"), ("d", "one two three five"), ("e", None)], "key string, text string")
    got = {r.key: (r.leader, r.method) for r in dedupe.dedupe_texts(d, 0.1).collect()}
    assert got["b"] == ("a", "normalized") and got["d"] == ("c", "near") and "e" not in got


def test_first_similar(spark):
    d = pairs(spark, [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta zeta"), (3, "alpha beta gamma delta epsilon"), (4, "")], "key long, body string")
    got = {r.key: (r.first, r.kind) for r in dedupe.first_similar(d, 0.4).collect()}
    assert got[2] == (1, "minhash") and got[3] == (1, "exact") and got[4][0] == 4


def _shuffled_rows(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    store, none = sc.statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_first_similar_at_size(spark):
    """Bodies that share most shingles of a place, and many without any: equal to brute force, and few rows a body are shuffled."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(30)] for _ in range(150)]
    rows = {}
    for _ in range(1200):
        x = r.choice(base)[:]
        for _ in range(r.choice([0, 1, 1, 3])):
            x[r.randrange(len(x))] = r.choice(words)
        rows[r.randrange(10**6)] = r.choice(["all of them begin so " + " ".join(x)] * 4 + ["привет " + "да" * r.randrange(200), None])
    d = pairs(spark, list(rows.items()), "key long, body string").localCheckpoint()
    done = _shuffled_rows(spark)
    got = {x.key: (x.first, x.kind) for x in dedupe.first_similar(d, 0.8).collect()}
    now = _shuffled_rows(spark)
    assert sum(v for k, v in now.items() if k not in done) < 40 * len(rows)

    sig = {}
    for k, t in rows.items():
        if t is not None:
            w = re.findall("[a-z0-9]+", t.lower())
            g = {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else set(w)
            sig[k] = tuple(min((hashlib.sha256(f"{s}:{x}".encode()).hexdigest()[:8] for x in g), default="ffffffff") for s in range(64))
    want, heads = {}, {}
    for k in sorted(sig):
        heads.setdefault(rows[k], k)
    for k in sig:
        head = heads[rows[k]]
        near = min((x for x in heads.values() if x < head and sum(p == q for p, q in zip(sig[x], sig[head], strict=True)) >= 52), default=None)
        exact = head if head < k else None
        first = min((x for x in (exact, near) if x is not None), default=None)
        want[k] = (k, "representative") if first is None else (first, "minhash" if first != exact else "exact")
    assert got == want and {x[1] for x in want.values()} == {"representative", "minhash", "exact"}


def test_sign_in_pieces():
    """Pieces and forgotten shingles leave the values alone."""
    texts = [["a b c", "b c d"], [], ["x"], ["a b c", "y z w", "q r s", "t u v", "b c d"], ["a b c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts, pa.list_(pa.string()))], ["key", "items"])
    want = [[min((int(hashlib.sha256(f"{s}:{g}".encode()).hexdigest()[:8], 16) for g in t), default=0xFFFFFFFF) for s in range(5)] for t in texts]
    for most in (1, 2, 3, 100):
        got = list(dedupe.sign(iter([batch, batch.slice(1, 3)]), 5, most))
        assert [x for b, _ in got for x in b.column(0).to_pylist()] == [0, 1, 2, 3, 4, 1, 2, 3]
        assert np.concatenate([v for _, v in got]).tolist() == want + want[1:4]


def test_text_signatures(spark, tmp_path):
    from corvane.queries import queries

    texts = {1: "One two, three four five. " * 3, 2: "", 3: "one two", 4: "One two, three four five. " * 3, 5: None, 6: "é ü", 7: "one two three six"}
    rows = [(k, t, None if k < 4 else "same title") for k, t in texts.items()]
    pairs(spark, rows, "doc_id long, text string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = {}
    for r in dedupe.minhash(pairs(spark, [(k, t) for k, t in texts.items() if t is not None], "key long, text string")).collect():
        plain.setdefault(r.key, {})[r.seed] = r.value
    got = {r.key: r for r in queries()["minhash_text_signatures"](spark, str(tmp_path)).collect()}
    assert {k: (r.representative, r.signature) for k, r in got.items()} == {k: (min(x for x in texts if texts[x] == texts[k]), ",".join(plain[k][i] for i in range(64))) for k in texts if k != 5}


def test_canonical_json(spark):
    rows = [('{"b":1.0,"a":[1e-7,true,null,"é\\u001f"]}', '{"a":[1e-7,true,null,"é\\u001f"],"b":1}'), ("{", None), (None, None)]
    got = pairs(spark, [(i, a) for i, (a, _) in enumerate(rows)], "i int, a string").select("i", canonical.canonical_json("a").alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [b for _, b in rows]
    assert canonical.number_text(1e21) == "1e+21" and canonical.number_text(0.5) == "0.5" and canonical.number_text(1.5e-9) == "1.5e-9" and canonical.number_text(1e-6) == "0.000001"


def test_redaction_and_schema():
    v = canonical.redact({"api-key": "x", "accessToken": "y", "url": "https://h/p?sig=1", "deep": [{"auth": "Bearer abc"}]})
    assert v == {"api-key": "[REDACTED]", "accessToken": "y", "url": "[REDACTED_SIGNED_URL]", "deep": [{"auth": "[REDACTED]"}]}
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "e": {"type": "string", "enum": ["a"]}}, "additionalProperties": False}
    assert canonical.schema_errors({"e": "b", "z": 1}, schema) == [("$.n", "is required"), ("$.e", "must be one of the enumerated values"), ("$.z", "is not allowed")]
    assert not canonical.schema_errors({"n": 2.0}, schema)


def test_text_functions(spark):
    d = pairs(spark, [("a b c d", "Ａ  B", "x\u001fy")], "w string, n string, q string")
    r = d.select(text.word_shingles(F.col("w")).alias("s"), text.normalize(F.col("n")).alias("n"), text.json_quoted(F.col("q")).alias("q"), text.fnv1a(F.lit("a")).alias("f"), text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first()
    assert r.s == ["a b c", "b c d", "c d", "d"] and r.n == "a b" and r.q == '"x\\u001fy"' and r.f == "e40c292c" and r.c == 0
    k = spark.range(1).select(text.listwise_kl(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("k"), text.pairwise_logistic(F.lit(1.0), F.lit(0.0)).alias("p"), text.margin_mse(F.lit(0.8), F.lit(0.2), F.lit(0.7), F.lit(0.1)).alias("m")).first()
    assert abs(k.k) < 1e-12 and abs(k.p - 0.3132616875) < 1e-9 and abs(k.m) < 1e-12


def test_metric_goldens(spark):
    scored = pairs(spark, [("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 0.5)], "query string, candidate string, score double")
    rel = pairs(spark, [("q", "a")], "query string, candidate string")
    assert evaluate.retrieval_metrics(scored, rel).first()[:] == (1, 1.0, 1.0, 1.0)
    c = evaluate.classification_metrics(pairs(spark, [("a", "a"), ("b", "a")], "predicted string, expected string"))
    assert {r.metric: r.value for r in c.collect()} == {"accuracy": 0.5, "macro-f1": round(1 / 3, 9)}
    assert evaluate.v_measure(pairs(spark, [("x", "a"), ("y", "b")], "predicted string, expected string")).first().v_measure == 1.0
    flat = evaluate.correlations(pairs(spark, [(1.0, 2.0), (1.0, 3.0)], "predicted double, expected double"))
    assert {r.value for r in flat.collect()} == {0.0}
    b = evaluate.bootstrap_interval([1.0, 2.0, 3.0], 7, 50)
    assert b == evaluate.bootstrap_interval([1.0, 2.0, 3.0], 7, 50) and b["low"] <= b["value"] <= b["high"]
    t = pairs(spark, [("m", "base", 0.5, None, None), ("none", "base", 0.1, None, None), ("m", "gone", None, None, 0.1)], "metric string, baseline string, minimum double, maximum double, minimum_delta double")
    got = evaluate.regressions(pairs(spark, [("m", 0.6)], "metric string, value double"), pairs(spark, [("base", "m", 0.5)], "baseline string, metric string, value double"), t)
    assert sorted((r.metric, r.baseline, r.passed) for r in got.collect()) == [("m", "base", True), ("m", "gone", False), ("none", "base", False)]


def test_ledger(spark):
    items = pairs(spark, [("a", 1.0), ("b", 1.0), ("b", 1.0)], "request string, estimate double")
    results = pairs(spark, [("a", 1, 0.3), ("a", 2, 9.0), ("b", 1, 2.0), ("x", 1, 5.0)], "request string, seq int, cost double")
    assert ledger.reconcile_batches(items, results).first()[:] == (2, 2, 0, 2.3)
    edges = pairs(spark, [("s", "c"), ("c", "t"), ("o", "e")], "parent string, child string")
    assert {r.id for r in ledger.deletion_plan(edges, pairs(spark, [("s",)], "id string")).collect()} == {"s", "c", "t"}


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"ok":1}\n\n{bad}\n')
    rows = jsonl.read_lines(spark, str(p))
    assert [(r.line, r.byte_offset) for r in rows.orderBy("line").collect()] == [(1, 0), (3, 10)]
    marked = {r.line: r.error for r in jsonl.parse_lines(rows, "mark").collect()}
    assert marked == {1: None, 3: "JSONL_MALFORMED"} and jsonl.parse_lines(rows, "drop").count() == 1
    with pytest.raises(Exception, match="line 3, byte 10"):
        jsonl.parse_lines(rows).collect()
    good = {"preferenceRecordVersion": "1.0.0", "id": "p", "prompt": "q", "chosen": "a", "rejected": "b", "split": "train"}
    p.write_text(json.dumps(good) + "\n" + json.dumps(good | {"rejected": "a"}) + "\n")
    ok, lost = jsonl.decode_preferences(jsonl.read_lines(spark, str(p)))
    assert ok.count() == 1 and [(r.line, r.code) for r in lost.collect()] == [(2, "PREFERENCE_PAIR")]


def test_freeze(spark, tmp_path):
    d = pairs(spark, [(2, "b", "r"), (1, "a", "r"), (1, "a", "s")], "n int, t string, root string")
    path = str(tmp_path / "frozen")
    m = frozen.freeze(d, path, "root")
    assert m["recordCount"] == 3 and m["lineageRoots"] == ["r", "s"] and frozen.verify_frozen(spark, path) == m
    assert frozen.freeze(d.repartition(3), str(tmp_path / "again"), "root") == m
    spark.createDataFrame([('{"n":9}',)], "value string").write.mode("append").text(f"{path}/records")
    with pytest.raises(ValueError, match="changed"):
        frozen.verify_frozen(spark, path)
    keys = frozen.put_blobs(pairs(spark, [(bytearray(b"x"),), (bytearray(b"x"),)], "content binary"), str(tmp_path / "blobs"))
    assert [bytes(r.content) for r in frozen.get_blobs(spark, str(tmp_path / "blobs"), keys).collect()] == [b"x"]
    (tmp_path / "art").mkdir()
    (tmp_path / "art" / "w.bin").write_bytes(b"1")
    inv = cut(frozen.inventory(spark, str(tmp_path / "art")))
    assert frozen.verify_inventory(inv, inv).count() == 0 and frozen.verify_inventory(inv, inv, ("need.json",)).count() == 1
    drop(inv)


def test_freeze_keeps_every_root(spark, tmp_path):
    n = 100_005
    d = spark.range(n).select(F.format_string("root-%06d", "id").alias("root"))
    m = frozen.freeze(d, str(tmp_path / "a"), "root")
    table = spark.read.parquet(str(tmp_path / "a" / m["lineageRootsPath"]))
    assert m["lineageRootCount"] == n == table.distinct().count() and m["lineageRoots"] is None
    assert frozen.freeze(d.repartition(5), str(tmp_path / "b"), "root") == m and frozen.verify_frozen(spark, str(tmp_path / "a")) == m
    table.limit(9).write.parquet(str(tmp_path / "part"))
    spark.read.parquet(str(tmp_path / "part")).write.mode("overwrite").parquet(str(tmp_path / "b" / "lineage_roots"))
    with pytest.raises(ValueError, match="roots"):
        frozen.verify_frozen(spark, str(tmp_path / "b"))


def test_stages(spark, tmp_path):
    runs = []
    a = Stage("a", lambda: (runs.append("a"), spark.range(3))[1])
    b = Stage("b", lambda x, k: (runs.append("b"), x.filter(F.col("id") < k))[1], ("a",), {"k": 2})
    first = run(spark, [b, a], str(tmp_path))
    again = run(spark, [b, a], str(tmp_path))
    assert runs == ["a", "b"] and spark.read.parquet(first["b"][0]).count() == 2 and all(r for _, r in again.values())
    with pytest.raises(ValueError, match="cycle"):
        order([Stage("x", None, ("y",)), Stage("y", None, ("x",))])


def test_training(spark):
    d = pairs(spark, [("b", [1, 2, 3], [1, -100, 3]), ("b", [4], [4])], "batch string, ids array<int>, labels array<int>")
    assert sorted(r.ids for r in training.collate(d).collect()) == [[1, 2, 3], [4, 0, 0]]
    people = training.personas(spark, [{"name": "Ada", "goal": "g0"}], ["g1", "g2"], 3)
    assert [(r.name, r.goal) for r in people.orderBy("id").collect()] == [("Ada", "g0"), ("Persona 2", "g2"), ("Persona 3", "g1")]
    t = training.trajectories(people, [{"name": "find", "parameters": {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}}}}])
    assert t.first().messages[1].tool_calls[0].arguments == '{"q":"sample"}'
    w = training.fit_weight(pairs(spark, [("r", i, 1.0, 2.0) for i in range(200)], "run string, pos int, x double, y double"), every=50)
    assert w.count() == 4 and abs(w.orderBy(F.desc("step")).first().weight - 2) < 0.01
    assert training.uuid7(1) < training.uuid7(2)


def test_streams(spark, tmp_path):
    from corvane.streaming import events

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"run":"a","sequence":0}\n{"run":"a","sequence":2}\n{"run":"b","sequence":0}\n')
    lines = events.stream_lines(spark, str(src), "run string, sequence long")
    q = events.gapless(lines.select("run", "sequence")).writeStream.format("memory").queryName("gaps").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("select * from gaps").collect()] == [("a", 2, 1)]
    s = lines.select(F.col("run").alias("identity"), F.timestamp_seconds(F.col("sequence") + 1_700_000_000).alias("ts"))
    q = events.paid_once(s).writeStream.format("memory").queryName("paid").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.identity for r in spark.sql("select * from paid").collect()) == ["a", "b"]
