import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import mixing, packing, token_budget
from corvane.llm import vector_neighbours as vn


def test_hilbert_is_a_walk():
    side = np.arange(8)
    grid = np.array([[a, b, c] for a in side for b in side for c in side])
    k = vn.hilbert_keys(grid, 3)
    assert sorted(k.tolist()) == list(range(512))
    path = grid[np.argsort(k)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()  # each step goes to a neighbouring cell


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 64))
    v = (centres[rng.integers(30, size=2500)] + 0.7 * rng.normal(size=(2500, 64))).astype(np.float32)
    v[7] = v[3]
    rows = [(i, x.tolist(), "z") for i, x in enumerate(v)] + [(9001, None, "z"), (9002, [0.0] * 64, "z"), (9003, [1.0] * 3, "z"), (9004, [None] + [1.0] * 63, "z"), (9005, [float("nan")] * 64, "z")]
    df = spark.createDataFrame(rows, "key long, vec array<float>, unit string")
    few, members = vn.nearest_vectors(df, curves=8, window=150)
    got = {}
    for r in few.collect():
        got.setdefault(r.key, {})[r.other] = r.cosine
    rep = {r.key: r.representative for r in members.collect()}
    assert rep[7] == 3 and len(rep) == 2500
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    u[7] = 0
    s = u @ u.T
    np.fill_diagonal(s, -2)
    s[7] = s[:, 7] = -2
    asked = [i for i in range(0, 2500, 100)]
    top = {i: set(np.argsort(-s[i])[:10].tolist()) for i in asked}
    assert np.mean([len(top[i] & got[i].keys()) / 10 for i in asked]) >= 0.9
    assert all(abs(c - s[i, j]) < 2e-3 for i in asked for j, c in got[i].items())
    assert vn.nearest_vectors(df.limit(0))[0].count() == 0


def test_every_rank_with_production_values(spark):
    rng = np.random.default_rng(1)
    tight = (rng.normal(size=64) + 0.01 * rng.normal(size=(400, 64))).astype(np.float32)
    for v in (rng.normal(size=(8, 64)).astype(np.float32), tight):
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, vec array<float>")
        ranks = {}
        for r in vn.nearest_vectors(df)[0].collect():
            ranks.setdefault(r.key, []).append(r.rank)
        want = list(range(1, min(10, len(v) - 1) + 1))
        assert len(ranks) == len(v) and all(sorted(x) == want for x in ranks.values())


def test_members_cover_every_usable_vector(spark, tmp_path):
    from corvane.llm.queries import queries

    v = np.random.default_rng(6).normal(size=(12, 64)).astype(np.float32)
    rows = [(i, v[i % 12].tolist()) for i in range(18)] + [(90, None), (91, [0.0] * 64)]  # keys 12 to 17 are copies
    spark.createDataFrame(rows, "vec_key long, vec array<float>").write.parquet(f"{tmp_path}/embedding_vectors.parquet")
    q = queries()
    rep = {r.vec_key: r.representative for r in q["p2_members"](spark, str(tmp_path)).collect()}
    assert rep == {i: i % 12 for i in range(18)}
    near = {}
    for r in q["p2_neighbours"](spark, str(tmp_path)).collect():
        near.setdefault(r.key, []).append((r.rank, r.other))
    assert set(near) == set(rep.values())
    u = v.astype(float) / np.linalg.norm(v, axis=1, keepdims=True)
    for key in rep:
        order = [rep[key]] + [o for _, o in sorted(near[rep[key]])]
        ten = [m for o in order for m in sorted(rep) if rep[m] == o and m != key][:10]
        want = sorted((-float(u[key % 12] @ u[m % 12]) for m in rep if m != key))[:10]
        assert np.allclose([-u[key % 12] @ u[m % 12] for m in ten], want, atol=2e-3)


def test_found_survives_half_precision(spark, tmp_path):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.950002 * a + np.sqrt(1 - 0.950002**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    half = (a.astype(np.float16).astype(np.float32) * b.astype(np.float16).astype(np.float32)).sum(axis=1)
    at = int(half.argmin())
    assert half[at] < 0.9499
    spark.createDataFrame([(1, a[at].tolist()), (2, b[at].tolist())], "vec_key long, vec array<float>").write.parquet(f"{tmp_path}/embedding_vectors.parquet")
    assert [tuple(r) for r in vn.p2_found(spark, str(tmp_path)).collect()] == [(1, 2)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=12), st.integers(1, 120))
def test_fullest_is_the_best_sum(sizes, room):
    sums = {0}
    for x in sizes:
        sums |= {a + x for a in sums if a + x <= room}
    lengths = sorted(set(sizes))
    counts = {x: sizes.count(x) for x in lengths}
    got = packing.fullest(lengths, counts, room)
    assert sum(got) == max(sums) and all(got.count(x) <= counts[x] for x in got)


def test_packing(spark):
    r = random.Random(1)
    sizes = [r.randrange(1, 300) for _ in range(900)] + [1000, 512, 0, 2048]
    items = spark.createDataFrame([(i, s, "z") for i, s in enumerate(sizes)] + [(5000, None, "z")], "key long, tokens long, profile string")
    limits = spark.createDataFrame([("s", 512), ("none", 0)], "profile string, capacity int")
    rows = packing.pack_items(items, limits).collect()
    fill = {}
    for x in rows:
        fill[x.bin] = fill.get(x.bin, 0) + x.tokens
    assert all(f <= 512 for f in fill.values()) and all(fill[x.bin] == x.filled for x in rows)
    per = {}
    for x in rows:
        per.setdefault(x.key, []).append(x)
    assert {k: sum(x.tokens for x in v) for k, v in per.items()} == {i: s for i, s in enumerate(sizes) if s}
    assert all(len(v) == 1 for k, v in per.items() if sizes[k] <= 512)
    assert len(fill) <= -(-sum(sizes) // 512) + 1
    assert packing.pack_items(items.limit(0), limits).count() == 0


def test_mix(spark):
    r = random.Random(3)
    docs = [(i, "big", r.randrange(50, 150), 0) for i in range(2000)] + [(3000 + i, "small", r.randrange(50, 150), 0) for i in range(200)] + [(9000, "off", 10, 0), (9001, None, 10, 0), (9002, "big", None, 0), (9003, "big", 0, 0)]
    d = spark.createDataFrame(docs, "key long, source string, tokens long, share int")
    t = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 4), ("gone", 0.1, 2)], "source string, share double, repeats int")
    rows = mixing.mix(d, t, tolerance=0.0).collect()
    used = {s: sum(x.tokens for x in rows if x.source == s) for s in ("big", "small")}
    assert abs(used["big"] / sum(used.values()) - 0.7 / 0.9) < 0.01
    assert max(x.repeat for x in rows if x.source == "small") <= 3 and max(x.repeat for x in rows if x.source == "big") == 0
    pos = [x.position for x in rows]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    half = len(rows) // 2
    share = [sum(x.tokens for x in p if x.source == "small") / sum(x.tokens for x in p) for p in (rows[:half], rows[half:])]
    assert share[1] > share[0] + 0.05  # the repeated source's weight rises
    assert mixing.mix(d.limit(0), t).count() == 0
    assert mixing.plan([], 0.1) == {}


def test_token_budget(spark, sf):
    rows = [(1, "Hello there, 42 boxes!", "en", "x"), (2, None, "en", "x"), (3, "", "de", "x"), (4, "Grüße " * 30_000, "de", "x")]
    d = spark.createDataFrame(rows, "key long, text string, lang string, tokens string")
    got = {r.key: r.est_tokens for r in token_budget.estimate_tokens(d).collect()}
    assert got[2] == got[3] == 0 and token_budget.estimate_tokens(d.limit(0)).count() == 0
    for r in token_budget.p6_accuracy(spark, sf).collect():
        if r.texts > 100:
            assert abs(r.est_tokens / r.tokens - 1) < 0.05
    f = token_budget.features(["añb 12 cd-3", ""])
    names = dict(zip(token_budget.FEATURES, f[0], strict=True))
    assert (names["bytes"], names["words"], names["digits"], names["digit_runs"], names["punctuation"], names["spaces"]) == (12, 4, 3, 2, 1, 2)
    assert token_budget.features(["abcdefghij abcdefgh"])[0][token_budget.FEATURES.index("long_words")] == 1


def test_pairs_of_a_dense_cluster_are_not_capped(spark):
    rng = np.random.default_rng(5)
    tight = (rng.normal(size=64) + 0.05 * rng.normal(size=(40, 64))).astype(np.float32)
    v = np.concatenate([tight, rng.normal(size=(300, 64)).astype(np.float32)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, vec array<float>")
    got = {(r.key, r.other) for r in vn.similar_vectors(df)[0].collect()}
    u = v.astype(float) / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    assert got == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= 0.95} and len(got) >= 780
    assert vn.similar_vectors(df.limit(0))[0].count() == 0


def test_schedule(spark):
    docs = spark.createDataFrame([(i, s, 10) for i, s in enumerate(["a"] * 100 + ["b"] * 100)], "key long, source string, tokens long")
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, share double, repeats int")
    rows = mixing.mix(docs, goals, schedule=[("a", 0.0, 1.0), ("a", 0.5, 0.0), ("b", 0.5, 0.0), ("b", 1.0, 3.0)]).collect()
    a, b = ([r.position for r in rows if r.source == s] for s in "ab")
    assert len(a) == len(b) == 100 and max(a) < 0.5 and min(b) >= 0.5 and a == sorted(a)
    assert abs(a[50] - 0.5 * (1 - np.sqrt(0.5))) < 1e-9  # half of a falling line's area
    for bad in ([("a", 2.0, 1.0)], [("a", 0.0, -1.0)], [("a", 0.0, 0.0)]):
        with pytest.raises(ValueError):
            mixing.mix(docs, goals, schedule=bad)
