"""Exact, normalized and near duplicates; leader clusters; contamination between splits."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import (
    fnv1a,
    hash_unit,
    hash_unit_compat,
    jaccard,
    normalize,
    salted,
    sensitive,
    text_hash,
    token_shingles,
    word_shingles,
)
from corvane.plans.cut import cut, drop
from corvane.plans.skew import join_per_key
from corvane.session import table

SEEDS = 64


def shard_representatives(rows: DataFrame) -> DataFrame:
    """``rows(hash, key)`` of any shards to ``(hash, representative, copies)``; a partial aggregate, hot hashes included."""
    return rows.filter("hash IS NOT NULL").groupBy("hash").agg(F.min("key").alias("representative"), F.count(F.lit(1)).alias("copies"))


def similar_pairs(sets: DataFrame, threshold: float, sides: bool = False) -> DataFrame:
    """All pairs ``(a, b, score)`` with ``a < b`` of ``sets(key, items array)`` whose Jaccard reaches ``threshold``.

    Lossless prefix join: a set's items go from rare to frequent and only the first
    ``n - ceil(t n) + 1`` are joined, as two similar sets share one of them; sizes must be within
    ``t``. Candidates are then computed on whole sets. With ``sides`` a column ``side`` must differ
    between the two. Empty and null sets pair with none. Sets that are equal should be collapsed
    first (``shard_representatives``): a group of copies would be all pairs of itself.
    """
    extra = ["side"] if sides else []
    base = cut(sets.filter(F.size("items") > 0).select("key", *extra, F.array_distinct(F.transform("items", lambda x: F.xxhash64(x))).alias("items")).withColumn("n", F.size("items")))
    terms = base.select("key", *extra, "n", F.explode("items").alias("h"))
    counts = terms.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("key").orderBy("df", "h")
    kept = terms.join(counts, "h").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("key", *extra, "n", "h")
    kept = cut(kept)
    a, b = (kept.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "n", *extra))) for s in "ab")
    ok = (F.col("key_a") < F.col("key_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9)
    if sides:
        ok = ok & (F.col("side_a") != F.col("side_b"))
    found = a.join(b, "h").filter(ok).select("key_a", "key_b").distinct()
    full = base.select("key", "items")
    pairs = found.join(full.select(F.col("key").alias("key_a"), F.col("items").alias("x")), "key_a").join(full.select(F.col("key").alias("key_b"), F.col("items").alias("y")), "key_b")
    return pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), jaccard(F.col("x"), F.col("y")).alias("score")).filter(F.col("score") >= threshold - 1e-12)


def similar_classes(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``sets(key, items array)`` to ``links(a, b, score)`` between representatives and ``members(key, representative)``.

    Keys with equal sets are a class under their least key; similar classes are linked once. All pairs
    of keys follow from both, and a class of copies of any size is one row of the join. Empty and null
    sets are in no class.
    """
    hashed = F.array_sort(F.array_distinct(F.transform("items", lambda x: F.xxhash64(x))))
    s = sets.filter(F.size("items") > 0).select("key", hashed.alias("items"))
    s = cut(s.withColumn("h", F.concat_ws("-", F.xxhash64("items").cast("string"), F.xxhash64(F.lit(7), "items").cast("string"))))  # two hashes, 128 bits
    firsts = cut(s.groupBy("h").agg(F.min("key").alias("representative"), F.count(F.lit(1)).alias("n")))
    reps = s.join(firsts.select("h", F.col("representative").alias("key")), ["h", "key"]).dropDuplicates(["h"]).select("key", "items")
    members = join_per_key(s.select("key", "h"), firsts, "h", s.count(), "n").select("key", "representative")
    return similar_pairs(reps, threshold), members


def leader_clusters(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """Leader clustering in key order: ``(key, leader)``.

    A key is a leader unless a lesser key that is a leader is similar to it; else it belongs to the
    least such leader. ``keys(key)``, ``pairs(a, b)`` with ``a < b``. A round makes leaders of the open
    keys without open lesser neighbours and closes what they are similar to; only edges between open
    keys go on to the next, so rounds shrink. Their number is the longest chain of dependent decisions.
    """
    edges = cut(pairs.select(F.col("b").alias("key"), F.col("a").alias("to")).distinct())
    new = cut(keys.select("key").distinct().join(edges.select("key").distinct(), "key", "left_anti"))
    leaders, rest = [new], edges
    while rest.limit(1).count():
        closed = cut(rest.join(new.withColumnRenamed("key", "to"), "to", "left_semi").select("key").distinct())
        still = cut(rest.join(closed, "key", "left_anti"))
        left = cut(still.join(closed.withColumnRenamed("key", "to"), "to", "left_anti"))
        new = cut(still.select("key").distinct().join(left.select("key").distinct(), "key", "left_anti"))
        leaders.append(new)
        for t in (closed, still, *([] if rest is edges else [rest])):
            drop(t)
        rest = left
    chief = leaders[0]
    for x in leaders[1:]:
        chief = chief.unionByName(x)
    chief = cut(chief) if len(leaders) > 1 else chief
    own = chief.select("key", F.col("key").alias("leader"))
    other = edges.join(chief.withColumnRenamed("key", "to"), "to").join(chief, "key", "left_anti").groupBy("key").agg(F.min("to").alias("leader"))
    return own.unionByName(other)


def dedupe_texts(rows: DataFrame, threshold: float = 0.85, semantic: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows(key, text)`` to ``(key, leader, method)``: exact, normalized, near or semantic duplicate of the leader; null for leaders.

    Equal normalized texts are collapsed before the near join; they stand in the same cluster,
    as equal texts are as similar to every leader. ``semantic(texts(key, text))`` gives further
    similar pairs ``(a, b)``, ``a < b``, of the texts left, as a vector search finds them.
    """
    norm = cut(rows.filter("text IS NOT NULL").select("key", "text", normalize(F.col("text")).alias("norm")))
    firsts = norm.groupBy("norm").agg(F.min("key").alias("first"))
    reps = firsts.select(F.col("first").alias("key"), word_shingles(F.col("norm")).alias("items"))
    pairs = similar_pairs(reps, threshold).select("a", "b")
    close = pairs.select(F.col("b").alias("first"), F.col("a").alias("lf"), F.lit(True).alias("by_words"))
    if semantic is not None:
        pairs = pairs.unionByName(semantic(firsts.select(F.col("first").alias("key"), F.col("norm").alias("text"))).select("a", "b"))
    lead = cut(leader_clusters(reps, pairs))
    of = norm.join(firsts, "norm").join(lead.withColumnRenamed("key", "first"), "first")
    chief = norm.select(F.col("key").alias("leader"), F.col("text").alias("lt"), F.col("norm").alias("ln"))
    method = F.when(F.col("key") == F.col("leader"), None).when(F.col("text") == F.col("lt"), "exact").when(F.col("norm") == F.col("ln"), "normalized").otherwise("near")
    got = of.join(chief, "leader").select("key", "leader", "first", method.alias("method"))
    if semantic is None:
        return got.select("key", "leader", "method")
    other = (F.col("method") == "near") & F.col("by_words").isNull()
    return got.join(close.withColumnRenamed("lf", "leader"), ["first", "leader"], "left").select("key", "leader", F.when(other, "semantic").otherwise(F.col("method")).alias("method"))


def minhash(rows: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """``rows(key, text)`` to ``(key, seed, value)``: per seed the least first 32 bits of SHA-256(seed:shingle), as hex.

    Each distinct shingle is hashed once a seed, not once a text; a text without shingles has ``ffffffff``.
    """
    sh = rows.select("key", F.explode_outer(token_shingles(F.col("text"))).alias("g"))
    each = sh.filter("g IS NOT NULL").select("g").distinct().select("g", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    h = each.select("g", "seed", F.substring(F.sha2(F.concat_ws(":", F.col("seed").cast("string"), "g"), 256), 1, 8).alias("h"))
    packed = h.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("seed", "h"))).alias("hs"))
    per = sh.filter("g IS NOT NULL").join(packed, "g").select("key", F.explode("hs").alias("x")).groupBy("key", F.col("x.seed").alias("seed")).agg(F.min("x.h").alias("value"))
    none = sh.filter("g IS NULL").select("key", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"), F.lit("ffffffff").alias("value"))
    return per.unionByName(none)


def text_signatures(rows: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """``rows(key, text)`` to ``(key, representative, signature)``: ``minhash`` of whole texts, its values in seed order, joined by commas.

    Equal texts are signed once, under their least key, which every key names; null texts are left
    out. Signed a batch at a time, each distinct shingle of it once, so no shingle is shuffled.
    """
    marked = cut(rows.filter("text IS NOT NULL").select("key", "text", F.sha2("text", 256).alias("hash")))
    firsts = marked.groupBy("hash").agg(F.min("key").alias("representative"), F.count(F.lit(1)).alias("copies"))
    firsts = cut(firsts)
    texts = marked.select("key", "hash", "text").join(firsts.select("hash", F.col("representative").alias("key")), ["hash", "key"]).dropDuplicates(["hash"])
    # hashing costs far more than the bytes tell, so the tasks are not left to adaptive coalescing
    sets = texts.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "hash").select("hash", token_shingles(F.col("text")).alias("items"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        starts = [f"{i}:".encode() for i in range(seeds)]
        for b in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
            items = b.column(1)
            words = items.flatten().dictionary_encode()
            distinct = [x.encode() for x in words.dictionary.to_pylist()]
            h = np.empty((len(distinct), seeds), np.uint32)
            for i, g in enumerate(distinct):
                h[i] = np.frombuffer(b"".join([sha(p + g).digest()[:4] for p in starts]), ">u4")
            at, ids = 0, words.indices.to_numpy()
            out = []
            for n in pc.list_value_length(items).to_pylist():
                least = h[ids[at : at + n]].min(axis=0) if n else np.full(seeds, 0xFFFFFFFF, np.uint32)
                at += n
                raw = least.astype(">u4").tobytes().hex()
                out.append(",".join(raw[8 * i : 8 * i + 8] for i in range(seeds)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["hash", "signature"])

    signed = sets.mapInArrow(sign, "hash string, signature string").join(firsts, "hash")
    return join_per_key(marked.select("key", "hash"), signed, "hash", marked.count(), "copies").select("key", "representative", "signature")


def sign(batches: Iterator[pa.RecordBatch], seeds: int = SEEDS, most: int = 100_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches whose last column holds shingles, in pieces, each with its ``(row, seed)`` minhashes as numbers.

    A piece has ``most`` shingles or one text. A task hashes a shingle once while it holds it: with more than three times ``most`` it begins anew.
    """
    sha = hashlib.sha256
    starts = [f"{i}:".encode() for i in range(seeds)]
    known: dict[str, int] = {}
    h = np.empty((0, seeds), np.uint32)
    for whole in batches:
        ends = np.cumsum(pc.list_value_length(whole.column(whole.num_columns - 1)).to_numpy(zero_copy_only=False))
        at = 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            b = whole.slice(at, to - at)
            items = b.column(b.num_columns - 1)
            words = items.flatten().dictionary_encode()
            distinct = words.dictionary.to_pylist()
            if len(known) > 3 * most:
                known, h = {}, h[:0]
            new = [g for g in distinct if g not in known]
            fresh = np.empty((len(new), seeds), np.uint32)
            for i, g in enumerate(x.encode() for x in new):
                fresh[i] = np.frombuffer(b"".join([sha(p + g).digest() for p in starts]), ">u4")[::8]  # the first 32 bits of each
            h = np.concatenate([h, fresh])
            known.update(zip(new, range(len(known), len(h)), strict=True))
            ids = np.array([known[g] for g in distinct], np.int64)[words.indices.to_numpy()]
            owner = np.repeat(np.arange(b.num_rows), np.diff(ends[at:to], prepend=ends[at - 1] if at else 0))
            least = np.full((b.num_rows, seeds), 0xFFFFFFFF, np.uint32)
            for i in range(0, len(ids), most):  # so a text of any length takes bounded memory here
                o = owner[i : i + most]
                first = np.flatnonzero(np.diff(o, prepend=-1))
                least[o[first]] = np.minimum(least[o[first]], np.minimum.reduceat(h[ids[i : i + most]], first, axis=0))
            yield b, least
            at = to


def first_similar(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows(key, body)`` to ``(key, first, kind)``: the least earlier key with an equal body or as many equal minhashes.

    Losslessly: two signatures that agree in ``need`` of 64 places differ in at most ``64 - need``, so
    of one band of places more than that, one agrees whole, and only bands are joined. Four bits of
    each place go along, as four numbers with a bit a place, and rule out most other pairs; the rest
    are computed on whole signatures. Equal bodies, then equal signatures, are collapsed first: a
    key's least similar key is that of its signature's class. Null bodies are left out.
    """
    need = math.ceil(threshold * SEEDS - 1e-9)
    edges = [i * SEEDS // (SEEDS - need + 1) for i in range(SEEDS - need + 2)]
    kind = rows.schema["key"].dataType.simpleString()
    marked = cut(rows.filter("body IS NOT NULL").select("key", "body", F.sha2("body", 256).alias("hash")))
    bodies = cut(marked.groupBy("hash").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("copies"), F.any_value("body").alias("body")))

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, v in sign(batches):
            raw = v.tobytes()
            size = 4 * SEEDS
            name = pa.array([hashlib.sha256(raw[i : i + size]).digest() for i in range(0, len(raw), size)], pa.binary())
            bits = np.stack([np.packbits((v >> k & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)[:, 0] for k in range(32)], axis=1)
            each = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, 32), pa.int32()), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], name, each], ["hash", "head", "copies", "class", "planes"])

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            p = b.column(1).flatten().to_numpy().reshape(-1, 32)
            for i, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                mask = np.uint64((1 << y) - (1 << x)).view(np.int64)
                h = np.full(len(p), i + 1, np.uint64)
                for k in range(32):
                    h = (h ^ (p[:, k] & mask).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64)), *(pa.array(p[:, k].copy()) for k in range(4))], ["head", "band", "p0", "p1", "p2", "p3"])

    # hashing costs far more than the bytes tell, so the tasks are not left to adaptive coalescing
    sets = bodies.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "hash").select("hash", "head", "copies", token_shingles(F.col("body")).alias("items"))
    signed = cut(sets.mapInArrow(planes, f"hash string, head {kind}, copies long, class binary, planes array<long>"))
    classes = cut(signed.groupBy("class").agg(F.min("head").alias("least"), F.count(F.lit(1)).alias("n"), F.any_value("planes").alias("planes")))
    part = classes.select("least", "planes").mapInArrow(bands, f"head {kind}, band long, p0 long, p1 long, p2 long, p3 long")
    a, b = (part.select("band", *(F.col(c).alias(f"{c}_{s}") for c in part.columns if c != "band")) for s in "ab")
    unlike = lambda x, y: F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), (p.bitwiseXOR(q) for p, q in zip(x, y, strict=True))))
    few = unlike(*([F.col(f"p{k}_{s}") for k in range(4)] for s in "ab")) <= SEEDS - need
    found = a.join(b, "band").filter((F.col("head_a") < F.col("head_b")) & few).select("head_a", "head_b").distinct()
    found = found.join(classes.select(F.col("least").alias("head_a"), F.col("planes").alias("x")), "head_a").join(classes.select(F.col("least").alias("head_b"), F.col("planes").alias("y")), "head_b")
    near = found.filter(unlike(*([F.get(c, F.lit(k)) for k in range(32)] for c in "xy")) <= SEEDS - need).groupBy(F.col("head_b").alias("least")).agg(F.min("head_a").alias("earlier"))
    of = classes.select("class", "n", "least").join(near, "least", "left").select("class", "n", F.coalesce("earlier", "least").alias("near"))
    n = signed.count()
    heads = join_per_key(signed.select("hash", "head", "copies", "class"), cut(of), "class", n, "n")
    heads = cut(heads.select("hash", "head", "copies", F.when(F.col("near") < F.col("head"), F.col("near")).alias("near")))
    d = join_per_key(marked.select("key", "hash"), heads, "hash", marked.count(), "copies")
    exact = F.when(F.col("head") < F.col("key"), F.col("head"))
    first = F.least(exact, "near")  # null arguments are skipped
    return d.select("key", F.coalesce(first, "key").alias("first"), F.when(first.isNull(), "representative").when(F.coalesce("near", F.col("key")) < F.coalesce(exact, F.col("key")), "minhash").otherwise("exact").alias("kind"))


def contamination(texts: DataFrame, near: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """``texts(key, text, side)``, sides 'train' and 'heldout', to ``links`` between classes and ``members``.

    ``members(key, side, class, exact)`` names each text's class of equal normalized forms on its side,
    its least key, and the class of bit-equal texts in it; ``links(train, heldout, score, equal)`` joins classes
    of both sides, ``equal`` where their forms are. All pairs follow from both. Null texts take
    no part.
    """
    t = texts.filter("text IS NOT NULL").select("key", "text", "side", normalize(F.col("text")).alias("norm"))
    t = cut(t.select("key", "side", "norm", F.sha2("norm", 256).alias("form"), F.sha2("text", 256).alias("exact")))
    firsts = cut(t.groupBy("form", "side").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("n")))
    reps = t.join(firsts.select("form", "side", F.col("class").alias("key")), ["form", "side", "key"]).dropDuplicates(["form", "side"])
    sets = cut(reps.select("key", "side", "form", F.transform(word_shingles(F.col("norm")), lambda x: F.xxhash64(x)).alias("items")))
    a, b = (firsts.filter(F.col("side") == s).select("form", F.col("class").alias(s)) for s in ("train", "heldout"))
    same = a.join(b, "form").select("train", "heldout", F.lit(1.0).alias("score"), F.lit(True).alias("equal"))
    pairs = similar_pairs(sets, near, sides=True)
    of = sets.select("key", "side", "form")
    x = pairs.join(of.select(F.col("key").alias("a"), F.col("form").alias("fa"), F.col("side").alias("sa")), "a").join(of.select(F.col("key").alias("b"), F.col("form").alias("fb")), "b").filter("fa <> fb")
    swap = F.col("sa") == "train"
    close = x.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("train"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("heldout"), "score", F.lit(False).alias("equal"))
    sized = firsts.withColumn("form_side", F.concat_ws(":", "side", "form"))
    members = join_per_key(t.select("key", "exact", F.concat_ws(":", "side", "form").alias("form_side")), sized.select("form_side", "side", "class", "n"), "form_side", t.count(), "n")
    return same.unionByName(close), members.select("key", "side", "class", "exact")


def contamination_counts(texts: DataFrame, near: float = 0.85) -> DataFrame:
    """One row a held-out text: ``(key, class, exact, normalized, near, best)``, how many training texts it equals or resembles, and the best near score."""
    links, members = contamination(texts, near)
    members = cut(members)
    train = members.filter("side = 'train'")
    sizes = train.groupBy(F.col("class").alias("train")).agg(F.count(F.lit(1)).alias("n"))
    copies = train.groupBy("class", "exact").agg(F.count(F.lit(1)).alias("same")).select(F.col("class").alias("train"), "exact", "same")
    sized = cut(links.join(sizes, "train"))
    equal = sized.filter("equal")
    close = sized.filter("NOT equal").groupBy(F.col("heldout").alias("class")).agg(F.sum("n").alias("near"), F.max("score").alias("best"))
    held = members.filter("side = 'heldout'")
    per = held.select("class", "exact").distinct().join(equal.select(F.col("heldout").alias("class"), "train", "n"), "class").join(copies, ["train", "exact"], "left").groupBy("class", "exact").agg(F.sum("n").alias("all"), F.sum(F.coalesce("same", F.lit(0))).alias("same"))
    out = held.join(per, ["class", "exact"], "left").join(close, "class", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return out.select("key", "class", z(F.col("same")).alias("exact"), (z(F.col("all")) - z(F.col("same"))).alias("normalized"), z(F.col("near")).alias("near"), F.round("best", 9).alias("best"))


def benchmark_exclusions(texts: DataFrame, benchmark: DataFrame, near: float = 0.85) -> DataFrame:
    """``texts(key, text)`` that equal or resemble a ``benchmark(key, text)``: ``(key, benchmark_class, kind, score)``, kind 'benchmark'.

    Benchmark texts with the same normalized form are one class under their least key.
    """
    sides = texts.select(F.struct(F.lit(0).alias("s"), "key").alias("key"), "text", F.lit("train").alias("side")).unionByName(benchmark.select(F.struct(F.lit(1).alias("s"), "key").alias("key"), "text", F.lit("heldout").alias("side")))
    links, members = contamination(sides, near)
    hit = members.filter("side = 'train'").join(links.select(F.col("train").alias("class"), "heldout", "score"), "class")
    return hit.select("key.key", F.col("heldout.key").alias("benchmark_class"), F.lit("benchmark").alias("kind"), "score")


def exact_overlap(rows: DataFrame) -> DataFrame:
    """``rows(key, body, split)``: for each row outside train how many train rows have the same lower-cased body."""
    low = rows.withColumn("low", F.lower("body"))
    train = low.filter("split = 'train'").groupBy("low").agg(F.count(F.lit(1)).alias("n"))
    return low.filter("split <> 'train'").join(train, "low", "left").select("key", "split", F.coalesce("n", F.lit(0)).alias("train_rows"))


def salted_split(c: Column, salt: str, train: float = 0.8, validation: float = 0.1) -> Column:
    """Split of a group by its salted hash."""
    u = hash_unit(salted(salt, c))
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def family_split(c: Column, salt: str, compat: bool = True, train: float = 0.8, validation: float = 0.1) -> Column:
    """Split of a family's root by hash; ``compat`` keeps the divisor for which every family is train at 0.8."""
    u = hash_unit_compat(text_hash(F.concat(F.lit(salt), F.char(F.lit(0)), c)), compat)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def locked_group_split(rows: DataFrame, salt: str) -> DataFrame:
    """``rows(key, group, locked_split, pos)``: a group's first locked split, else its hash's, for all its rows."""
    g = rows.groupBy("group").agg(F.min_by("locked_split", F.when(F.col("locked_split").isNotNull(), F.col("pos"))).alias("locked"))
    return rows.join(g, "group").select("key", "group", F.coalesce("locked", salted_split(F.col("group"), salt)).alias("split"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("key"), "text")


def _sets(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).filter("text IS NOT NULL").select("key", word_shingles(normalize(F.col("text"), compose=False)).alias("items"))


def _log_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "production_logs").select("log_id", F.posexplode("messages").alias("i", "m")).select("log_id", F.col("i").alias("msg_idx"), F.col("m.content").alias("content"))


def _chat_bodies(s: SparkSession, d: str) -> DataFrame:
    from corvane.operators.chat import message_text

    body = F.lower(message_text(F.try_element_at("messages", F.lit(-1))))  # before the shuffle, so that messages are not in it
    rows = table(s, d, "chat_examples").select("example_id", body.alias("body"), "split", "ingested_at")
    return rows.groupBy(F.col("example_id").alias("key")).agg(F.max_by("body", "ingested_at").alias("body"), F.max_by("split", "ingested_at").alias("split"))


def _sided(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).withColumn("side", F.when(salted_split(F.col("key").cast("string"), "s") == "train", "train").otherwise("heldout"))


QUERIES = {
    "content_ids_fnv": lambda s, d: table(s, d, "documents").filter("title IS NOT NULL").select("doc_id", fnv1a(F.col("title")).alias("content_id")),
    "text_hash_states": lambda s, d: table(s, d, "embedding_texts").select("text_key", F.when(F.coalesce("text_hash", F.lit("")) == "", "missing").when(F.col("text_hash") == text_hash(F.col("text")), "right").otherwise("stale").alias("state")),
    "sensitive_findings": lambda s, d: _log_texts(s, d).select("log_id", "msg_idx", F.explode(sensitive(F.col("content"))).alias("x")).select("log_id", "msg_idx", "x.kind", "x.match"),
    "policy_decisions": lambda s, d: _log_texts(s, d).groupBy("log_id").agg(F.sum(F.coalesce(F.size(sensitive(F.col("content"))), F.lit(0))).alias("findings")).select("log_id", "findings", F.when(F.col("findings") > 0, "rejected").otherwise("accepted").alias("outcome")),
    "exact_dedupe": lambda s, d: shard_representatives(_docs(s, d).select(F.sha2("text", 256).alias("hash"), "key")),
    "normalized_dedupe": lambda s, d: shard_representatives(_docs(s, d).select(F.sha2(normalize(F.col("text"), compose=False), 256).alias("hash"), "key")),
    "near_dup_links": lambda s, d: similar_classes(_sets(s, d), 0.85)[0].withColumn("score", F.round("score", 9)),
    "near_dup_members": lambda s, d: similar_classes(_sets(s, d), 0.85)[1],
    "leader_clusters": lambda s, d: dedupe_texts(_docs(s, d)),
    "minhash_signatures": lambda s, d: minhash(table(s, d, "documents").filter("title IS NOT NULL").groupBy(F.col("title").alias("text")).agg(F.min("doc_id").alias("key"))).groupBy("key").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("seed", "value"))), lambda x: x["value"])).alias("signature")),
    "minhash_text_signatures": lambda s, d: text_signatures(_docs(s, d)),
    "chat_dedupe_first_prior": lambda s, d: first_similar(_chat_bodies(s, d).select("key", "body"), 0.8),
    "contamination_counts": lambda s, d: contamination_counts(_sided(s, d)),
    "contamination_exact_overlap": lambda s, d: exact_overlap(_chat_bodies(s, d)),
    "salted_split": lambda s, d: table(s, d, "documents").select("doc_id", salted_split(F.col("doc_id").cast("string"), "s").alias("split")),
    "embedding_split_compat": lambda s, d: table(s, d, "embedding_records").select("record_id", family_split(F.col("split_group"), "s").alias("compat_split"), family_split(F.col("split_group"), "s", compat=False).alias("split")),
    "split_counts": lambda s, d: table(s, d, "documents").groupBy(salted_split(F.col("doc_id").cast("string"), "s").alias("split")).agg(F.count(F.lit(1)).alias("rows")),
    "group_split_locked": lambda s, d: locked_group_split(table(s, d, "import_records").select(F.col("row_key").alias("key"), F.coalesce("group_key", F.concat(F.lit("row-"), "record_id")).alias("group"), F.when(F.col("split") != "train", F.col("split")).alias("locked_split"), F.col("line_no").alias("pos")), "s"),
    "dedupe_shard_reconcile": lambda s, d: shard_representatives(table(s, d, "embedding_texts").select(F.col("text_hash").alias("hash"), F.col("text_key").alias("key")).filter("hash <> ''")),
}

_SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_NORM = f"trim(regexp_replace(lower(text), '{_SPACE}+', ' ', 'g'))"
_SH = "list_distinct(list_transform(w, lambda x, i: array_to_string(w[i:i+2], ' ')))"
_SETS = f"n AS (SELECT doc_id AS key, text, {_NORM} AS norm FROM documents WHERE text IS NOT NULL), s AS (SELECT key, norm, {_SH} AS g FROM (SELECT *, string_split(norm, ' ') AS w FROM n))"
_UNIT = "('0x' || substr(sha256('s' || chr(0) || {}), 1, 12))::BIGINT / 281474976710655::DOUBLE"
_SPLIT = "CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END"
_FAMILY = "('0x' || substr(sha256(to_json('s' || chr(0) || split_group)::VARCHAR), 1, 13))::BIGINT"
_FIND = r"""list_transform(regexp_extract_all(content, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'), lambda x: {'kind': 'pii', 'match': x})
 || list_transform(regexp_extract_all(content, '\b(?:\+?[0-9][ -]?){10,14}\b'), lambda x: {'kind': 'pii', 'match': x})
 || list_transform(regexp_extract_all(content, '(?i)\b(?:sk-[A-Za-z0-9_-]{12,}|AKIA[0-9A-Z]{16}|(?:api[_-]?key|password)\s*[:=]\s*[^\s,;]+)'), lambda x: {'kind': 'secret', 'match': x})"""
_LOGS = "l AS (SELECT log_id, generate_subscripts(messages, 1) - 1 AS msg_idx, unnest(messages).content AS content FROM production_logs)"
_BODIES = """b AS (SELECT example_id AS key, split, lower(coalesce(array_to_string(list_transform(list_filter(messages[-1].content, lambda p: p.type = 'text'), lambda p: coalesce(p.text, '')), chr(10)), '')) AS body
 FROM (SELECT * FROM chat_examples QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY ingested_at DESC) = 1))"""
SQL = {
    "content_ids_fnv": """SELECT doc_id, lpad(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(title, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0') AS content_id FROM documents WHERE title IS NOT NULL""",
    "text_hash_states": "SELECT text_key, CASE WHEN coalesce(text_hash, '') = '' THEN 'missing' WHEN text_hash = sha256(to_json(text)::VARCHAR) THEN 'right' ELSE 'stale' END AS state FROM embedding_texts",
    "sensitive_findings": f"WITH {_LOGS} SELECT log_id, msg_idx::INTEGER AS msg_idx, x.kind AS kind, x.match AS match FROM (SELECT log_id, msg_idx, unnest({_FIND}) AS x FROM l WHERE content IS NOT NULL)",
    "policy_decisions": f"WITH {_LOGS}, f AS (SELECT log_id, sum(coalesce(len({_FIND}), 0))::BIGINT AS findings FROM l GROUP BY 1) SELECT log_id, findings, CASE WHEN findings > 0 THEN 'rejected' ELSE 'accepted' END AS outcome FROM f",
    "exact_dedupe": "SELECT sha256(text) AS hash, min(doc_id) AS representative, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "normalized_dedupe": f"SELECT sha256({_NORM}) AS hash, min(doc_id) AS representative, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "near_dup_links": f"""WITH {_SETS}, r AS (SELECT min(key) AS key, g FROM (SELECT key, list_sort(g) AS g FROM s) GROUP BY g), t AS (SELECT key, len(g) AS n, unnest(g) AS h FROM r),
p AS (SELECT a.key AS a, b.key AS b, count(*)::DOUBLE AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.h = b.h AND a.key < b.key GROUP BY ALL)
SELECT a, b, round(k / (na + nb - k), 9) AS score FROM p WHERE k / (na + nb - k) >= 0.85""",
    "near_dup_members": f"WITH {_SETS} SELECT key, min(key) OVER (PARTITION BY list_sort(g)) AS representative FROM s",
    "minhash_signatures": r"""WITH t AS (SELECT min(doc_id) AS key, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM documents WHERE title IS NOT NULL GROUP BY title),
g AS (SELECT key, list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM t),
m AS (SELECT key, seed, coalesce(list_min(list_transform(g, lambda x: substr(sha256(seed || ':' || x), 1, 8))), 'ffffffff') AS v FROM g, range(64) r(seed))
SELECT key, string_agg(v, ',' ORDER BY seed) AS signature FROM m GROUP BY key""",
    "contamination_counts": f"""WITH {_SETS}, y AS (SELECT s.key, n.text, s.norm, s.g, {_UNIT.format("s.key::VARCHAR")} < 0.8 AS train FROM s JOIN n USING (key)),
same AS (SELECT b.key, count(*) FILTER (WHERE a.text = b.text) AS exact, count(*) FILTER (WHERE a.text <> b.text) AS normalized FROM y a JOIN y b ON a.norm = b.norm WHERE a.train AND NOT b.train GROUP BY 1),
t AS (SELECT key, train, norm, len(g) AS n, unnest(g) AS h FROM y),
p AS (SELECT a.key AS train, b.key AS key, count(*)::DOUBLE AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.h = b.h AND a.train AND NOT b.train AND a.norm <> b.norm GROUP BY ALL),
c AS (SELECT key, count(*) AS near, max(k / (na + nb - k)) AS best FROM p WHERE k / (na + nb - k) >= 0.85 GROUP BY 1)
SELECT key, min(key) OVER (PARTITION BY norm) AS class, coalesce(exact, 0) AS exact, coalesce(normalized, 0) AS normalized, coalesce(near, 0) AS near, round(best, 9) AS best
FROM y LEFT JOIN same USING (key) LEFT JOIN c USING (key) WHERE NOT train""",
    "contamination_exact_overlap": f"WITH {_BODIES}, t AS (SELECT body, count(*) AS n FROM b WHERE split = 'train' GROUP BY 1) SELECT key, split, coalesce(n, 0)::BIGINT AS train_rows FROM b LEFT JOIN t USING (body) WHERE split <> 'train'",
    "salted_split": f"SELECT doc_id, {_SPLIT} AS split FROM (SELECT doc_id, {_UNIT.format('doc_id::VARCHAR')} AS u FROM documents)",
    "embedding_split_compat": f"""SELECT record_id, {_SPLIT.replace("u <", "c <")} AS compat_split, {_SPLIT} AS split FROM (SELECT record_id, {_FAMILY} / 9007199254740991::DOUBLE AS c, {_FAMILY} / 4503599627370495::DOUBLE AS u FROM embedding_records)""",
    "split_counts": f"SELECT {_SPLIT} AS split, count(*) AS rows FROM (SELECT {_UNIT.format('doc_id::VARCHAR')} AS u FROM documents) GROUP BY 1",
    "group_split_locked": f"""WITH r AS (SELECT row_key AS key, coalesce(group_key, 'row-' || record_id) AS g, CASE WHEN split <> 'train' THEN split END AS l, line_no FROM import_records),
k AS (SELECT g, arg_min(l, line_no) FILTER (WHERE l IS NOT NULL) AS locked, {_UNIT.format("g")} AS u FROM r GROUP BY g)
SELECT key, g AS "group", coalesce(locked, {_SPLIT}) AS split FROM r JOIN k USING (g)""",
    "dedupe_shard_reconcile": "SELECT text_hash AS hash, min(text_key) AS representative, count(*) AS copies FROM embedding_texts WHERE text_hash <> '' GROUP BY 1",
}
