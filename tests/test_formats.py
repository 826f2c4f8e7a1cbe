import json

from corvane.operators import formats as fm

T = {"model": "m", "revision": "1", "requestId": "q"}
# one good external row of every kind, and the kind it becomes
GOOD = [
    ("query-document", None, {"query": "a b", "document": "c", "note": 1}), ("triplet", None, {"anchor": "a", "positive": "b", "negative": "c"}), ("triplet", "pair", {"query": "a", "document": "b", "negative": "c"}), ("retrieval-set", None, {"query": "a", "positives": ["b", "c"], "negatives": ["d"]}),
    ("boolean-pair", "boolean-pair", {"left": "a", "right": "b", "label": True}), ("categorical-pair", "categorical-pair", {"text1": "a", "text2": "b", "label": "x", "labels": ["x", "y"]}), ("scored-pair", "scored-pair", {"left": "a", "right": "b", "score": 0.5, "score_min": 0, "score_max": 1, "score_direction": "higher-is-more-similar"}),
    ("sts", "sts", {"left": "a", "right": "b", "score": 5, "score_min": 0, "score_max": 5}), ("classification", "classification", {"text": "a", "label": "x", "labels": ["x"]}), ("clustering", "clustering", {"text": "a", "label": "x", "labels": ["x"]}), ("instruction-aware", "instruction-aware", {"instruction": "find", "text": "a", "role": "query"}),
    ("teacher-vector", None, {"text": "a", "vector": [0.6, 0.8], "teacher": T, "norm": "l2"}), ("teacher-score", "teacher-score", {"query": "a", "document": "b", "teacher": T, "score": 1, "scale": {"min": 0, "max": 2, "direction": "higher-is-more-relevant"}, "margin": 0.25}),
    ("teacher-ranking", None, {"query": "a", "teacher": T, "candidate_pool_id": "p", "corpus_id": "c", "candidates": [{"id": "1", "documentId": "d1"}, {"id": "2", "documentId": "d2"}], "ranking": ["2", "1"]}),
]
BAD = [
    ("EMBED_JSON", None, "{"), ("EMBED_JSON", None, None), ("EMBED_JSON", None, "[1]"), ("EMBED_TASK_MAPPING_REQUIRED", None, {"x": 1}), ("EMBED_AMBIGUOUS_COLUMNS", None, {"text": "a", "label": "b"}), ("EMBED_TEXT_REQUIRED", None, {"query": " ", "document": "c"}), ("EMBED_TEXT_REQUIRED", None, {"query": 5, "document": "c"}),
    ("EMBED_TEXT_REQUIRED", "pair", {"query": "a", "document": "b", "negative": ""}), ("EMBED_UNSUPPORTED_TASK", "other", {"query": "a"}), ("EMBED_SCORE_SCALE", "sts", {"left": "a", "right": "b", "score": 6, "score_min": 0, "score_max": 5}), ("EMBED_SCORE_SCALE", "sts", {"left": "a", "right": "b"}),
    ("EMBED_LABEL_DOMAIN", "classification", {"text": "a", "label": "z", "labels": ["x"]}), ("EMBED_LABEL_DOMAIN", "boolean-pair", {"left": "a", "right": "b", "label": "true"}), ("EMBED_INSTRUCTION_SEPARATION", "instruction-aware", {"instruction": "find", "text": "find a", "role": "query"}), ("EMBED_POSITIVE_REQUIRED", None, {"query": "a", "positives": [], "negatives": []}),
    ("EMBED_POSITIVE_NEGATIVE_CONFLICT", None, {"query": "a", "positives": ["b"], "negatives": ["b"]}), ("EMBED_TEACHER_PROVENANCE", None, {"text": "a", "vector": [1.0], "teacher": {"revision": "1"}}), ("EMBED_VECTOR_SHAPE", None, {"text": "a", "vector": None, "teacher": T}), ("EMBED_VECTOR_NORM", None, {"text": "a", "vector": [1.0, 1.0], "teacher": T, "norm": "l2"}),
    ("EMBED_RANKING_POOL", None, {"query": "a", "teacher": T, "candidate_pool_id": "p", "corpus_id": "c", "candidates": [{"id": "1", "documentId": "d"}], "ranking": ["2"]}), ("EMBED_GROUPS_MISSING", None, {"query": "a", "document": "b", "split_group": ""}),
]


def _rows(spark, cases):
    rows = [(i, json.dumps({"split_group": "g"} | p) if isinstance(p, dict) else p, t) for i, (_, t, p) in enumerate(cases)]
    return spark.createDataFrame(rows, "key long, payload string, task string")


def test_every_kind_decodes_and_encodes(spark):
    got = {r.key: r for r in fm.decode_records(_rows(spark, GOOD)).collect()}
    assert [(got[i].kind, got[i].error) for i in range(len(GOOD))] == [(k, None) for k, _, _ in GOOD]
    assert got[0].extra == '{"note":"1"}' and [t.role for t in got[2].texts] == ["anchor", "positive", "negative"]
    back = {r.record_id: json.loads(r.value) for r in fm.encode_records(fm.decode_records(_rows(spark, GOOD))).collect()}
    for i, (_, _, p) in enumerate(GOOD):
        row = back[got[i].record_id]
        if i == 2:
            p = {"anchor": "a", "positive": "b", "negative": "c"}
        if i == 5:
            p = {"left": "a", "right": "b", "label": "x", "labels": ["x", "y"]}
        assert row == {"id": got[i].record_id, "split_group": "g"} | {k: v for k, v in p.items() if k != "note"}


def test_every_rule_has_its_code(spark):
    got = {r.key: r for r in fm.decode_records(_rows(spark, BAD)).collect()}
    assert [got[i].error for i in range(len(BAD))] == [c for c, _, _ in BAD]
    assert all(got[i].kind is None and got[i].texts is None for i in range(len(BAD)))
    assert fm.decode_records(_rows(spark, BAD).limit(0)).count() == 0


def test_losses(spark):
    d = fm.decode_records(_rows(spark, GOOD))
    from pyspark.sql import functions as F

    got = {(r.kind, r.loss) for r in fm.encode_records(d.withColumn("storage", F.lit("shard")).withColumn("kind", F.when(F.col("kind") == "sts", "odd").otherwise(F.col("kind")))).filter("value IS NULL").collect()}
    assert got == {("teacher-vector", "EMBED_VECTOR_SIDECAR_REQUIRED"), ("odd", "EMBED_UNSUPPORTED_EXPORT")}
