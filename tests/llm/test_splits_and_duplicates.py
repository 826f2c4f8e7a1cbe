import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corvane.llm import format_duplicates as fd
from corvane.llm import group_splits as gs
from corvane.llm import split_overlap as so


def test_allocation_meets_quotas():
    r = random.Random(1)
    bundles = [(s, p, r.randrange(1, 400 // s + 2)) for s in range(1, 30) for p in "ab"] + [(900, "a", 1)]
    ratios = {"train": 0.8, "validation": 0.1, "test": 0.1}
    out = gs.allocate(bundles, ratios)
    assert all(sum(x.values()) == c for (_, _, c), x in zip(bundles, out, strict=True))
    total = sum(s * c for s, _, c in bundles)
    for k, w in ratios.items():
        assert abs(sum(s * x[k] for (s, _, _), x in zip(bundles, out, strict=True)) / total - w) < 0.02
    assert gs.allocate([], ratios) == []


def test_group_splits(spark):
    r = random.Random(2)
    recs = [(f"r{i}", r.choice(["train", "test", None]), r.choice("xy"), i) for i in range(900)] + [("r1", "train", "x", 0), (None, "train", "x", 1)]
    keys = [(f"r{i}", f"k{i // r.randrange(1, 4)}") for i in range(900)] + [(f"r{i}", "hot") for i in range(300)] + [("r5", None), ("r6", "")]
    records = spark.createDataFrame(recs, "record string, split string, profile string, component int")
    got = gs.group_splits(records, spark.createDataFrame(keys, "record string, key string"), {"train": 0.6, "test": 0.4}).collect()
    assert Counter(x.record for x in got) == Counter({f"r{i}": 1 for i in range(900)})
    by, given = defaultdict(set), defaultdict(set)
    for x in got:
        by[x.component].add(x.split)
    assert all(len(v) == 1 for v in by.values())
    comp = {x.record: x.component for x in got}
    for a, s, *_ in recs:
        if a and s:
            given[comp[a]].add(s)
    assert all(x.conflict == (len(given[x.component]) > 1) and x.given_splits == sorted(given[x.component]) for x in got)
    share = Counter(x.split for x in got)["train"] / 900
    assert abs(share - 0.6) < 0.05
    empty = gs.group_splits(records.limit(0), spark.createDataFrame([], "record string, key string"), {"train": 1.0})
    assert empty.count() == 0


def test_bloom_merge_never_loses_a_repeat(spark):
    values = [i * 7919 for i in range(3000)] + [i * 7919 for i in range(0, 3000, 50)]
    h = spark.createDataFrame([(v,) for v in values], "x long").select(F.xxhash64("x").alias("x")).repartition(5)
    packed, bits = fd.repeat_filter(h, len(values))
    import numpy as np

    def hit(rows):
        at = fd._positions(np.array([r.x for r in rows]), bits)
        return ((packed[at >> 3] >> (7 - (at & 7))) & 1).reshape(fd.PROBES, -1).all(axis=0)

    repeated = spark.createDataFrame([(i * 7919,) for i in range(0, 3000, 50)], "x long").select(F.xxhash64("x").alias("x")).collect()
    assert hit(repeated).all()
    assert hit(h.distinct().collect()).mean() < 0.05


def test_format_duplicates(spark):
    texts = ["A-b C", "ab c", "ABC!", "other", None, "", "...", "straße 1", "STRASSE 1", "x" * 100_000, "X" * 100_000 + "?", "Ünï", "ünï "]
    rows = spark.createDataFrame([("t", i, t, "z") for i, t in enumerate(texts)], "tbl string, key long, text string, copies string").withColumn("canonical", fd.canonical_text(F.col("text")))
    squeeze = lambda t: "".join(re.findall(r"[^\W_]", t)).lower()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        if t is not None:
            groups[squeeze(t)].append(i)
    want = {i: (min(g), len(g)) for g in groups.values() for i in g}
    for bits in (fd.MAX_BITS, 8):  # also with a filter so small that it lets everything through
        got = {r.key: (r.representative, r.copies) for r in fd.format_duplicates(rows, bits).collect()}
        assert got == want
    assert fd.format_duplicates(rows.limit(0)).count() == 0


def test_fields(spark):
    p = ['{"Query": "A b", "n": 1}', '{"n":1.0,"query":"ab"}', '{"n":"1","query":"ab"}', '{"query": "a', "[1]", None, '{"query":null}', '{"query":NaN}']
    got = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p string").select("i", fd.canonical_fields("p").alias("c")).orderBy("i").collect()]
    assert got[0] == got[1] != got[2] and got[3] is got[4] is got[5] is got[7] is None and got[6] is not None


def _brute(texts, size=3, t=0.8):
    word = re.compile(r"[^\W_]+")
    sets = {}
    for k, x, s in texts:
        w = word.findall((x or "").lower())
        sets[k] = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()), s, "".join(w))
    return {(a, b) for a, (x, s, c) in sets.items() for b, (y, u, d) in sets.items() if s in ("validation", "test") and u == "train" and ((c == d and texts[0] is not None) or (x and y and len(x & y) / len(x | y) >= t))}


def test_split_overlap_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(r.choices(words, k=r.randrange(0, 30))) for _ in range(60)]
    rows = []
    for i in range(400):
        w = r.choice(base).split()
        for _ in range(r.randrange(0, 3)):
            if w:
                w[r.randrange(len(w))] = r.choice(words)
        t = " ".join(w)
        rows.append((i, r.choice([t, t.upper(), t + "."]), r.choice(["train", "train", "validation", "test", None])))
    rows += [(900, "solo", "train"), (901, "Solo!", "test"), (902, "two words", "train"), (903, "two  words", "validation"), (904, "long " * 20000, "train"), (905, "long " * 20001, "test")]
    texts = spark.createDataFrame([(k, f"r{k}", t, 1.0) for k, t, _ in rows] + [(999, "r1", None, 1.0)], "key long, record string, text string, n double")
    splits = spark.createDataFrame([(f"r{k}", s) for k, _, s in rows], "record string, split string")
    got = {(x.e_key, x.t_key) for x in so._pairs(texts, splits).collect()}
    assert got == _brute(rows)
    assert so._pairs(texts.limit(0), splits).count() == 0
