"""Same or near-same texts across splits: a weighted cosine join over inverted lists with lossless pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.format_duplicates import canonical_text
from corvane.llm.kernels import mix, shingle_sets
from corvane.plans.cut import cut
from corvane.session import table

#: Counters of the term-frequency sketch (4 bytes each); it only orders terms, so collisions cost time, never a pair.
COUNTERS = 1 << 21
_SEGMENT = 1 << 16
_EPS = 1e-6


def term_counts(texts: DataFrame, size: int, counters: int = COUNTERS) -> np.ndarray:
    """How many of all ``texts(text)`` hold a term, for each of ``counters`` hash classes of terms."""
    shift = np.uint64(64 - (counters.bit_length() - 1))
    segment = min(_SEGMENT, counters)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(counters, np.int64)
        for b in batches:
            h, _ = shingle_sets(b.column(0).to_pylist(), size)
            n += np.bincount((h >> shift).astype(np.int64), minlength=counters)
        for s in range(counters // segment):  # a task with few terms sends few bytes
            part = n[s * segment : (s + 1) * segment]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([at.astype(np.uint16).tobytes()]), pa.array([np.minimum(part[at], 2**32 - 1).astype(np.uint32).tobytes()])], ["seg", "at", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            for s, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums = kept.setdefault(s, np.zeros(segment, np.int64))
                sums[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        for s, n in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.minimum(n, 2**32 - 1).astype(np.uint32).tobytes()])], ["seg", "n"])

    merged = texts.mapInArrow(fill, "seg long, at binary, n binary").repartition(max(1, min(16, counters // segment)), "seg").mapInArrow(merge, "seg long, n binary")
    out = np.zeros(counters, np.uint32)
    for r in merged.toLocalIterator():  # 4 * counters bytes in all
        out[r[0] * segment : (r[0] + 1) * segment] = np.frombuffer(r[1], np.uint32)
    return out


def signatures(texts: DataFrame, counts: np.ndarray, size: int, cosine: float) -> DataFrame:
    """To every row of ``texts(text, ...)`` a hash of its term set, the set's size, and the terms that must be indexed.

    Terms go from rare to frequent. A text's vector gives each of its n terms the weight 1/sqrt(n);
    the terms kept are the least prefix after which the rest of the vector has a norm under
    ``cosine``: two vectors that reach ``cosine`` share a kept term. ``text`` itself goes.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)  # 4 * COUNTERS bytes
    shift = np.uint64(64 - (len(counts).bit_length() - 1))
    rest = [c for c in texts.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "set_a long", "set_b long", "n int", "terms array<long>"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h, start = shingle_sets(b.column("text").to_pylist(), size)
            n = np.diff(start)
            owner = np.repeat(np.arange(len(n)), n)
            hashes = []
            for k in (1, 2):
                m = mix(h * np.uint64(2 * k + 1) + np.uint64(k))
                c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m, dtype=np.uint64)])
                hashes.append((c[start[1:]] - c[start[:-1]]).view(np.int64))
            h = h[np.lexsort((h, shared.value[(h >> shift).astype(np.int64)], owner))]
            before = np.sqrt((start[owner + 1] - np.arange(len(h))) / np.maximum(n[owner], 1))  # norm from this term on
            kept = before >= cosine - _EPS
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(n)))]).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[kept].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(hashes[0]), pa.array(hashes[1]), pa.array(n.astype(np.int32)), terms], [*rest, "set_a", "set_b", "n", "terms"])

    return texts.mapInArrow(sign, schema)


def _similarity(size: int):
    @F.pandas_udf(T.StructType([T.StructField("jaccard", T.DoubleType()), T.StructField("cosine", T.DoubleType())]))
    def similarity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        ha, sa = shingle_sets(a.tolist(), size)
        hb, sb = shingle_sets(b.tolist(), size)
        na, nb = np.diff(sa), np.diff(sb)
        pair = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
        h = np.concatenate([ha, hb])
        order = np.lexsort((h, pair))
        h, pair = h[order], pair[order]
        both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=len(na))
        return pd.DataFrame({"jaccard": both / np.maximum(na + nb - both, 1), "cosine": both / np.sqrt(np.maximum(na * nb, 1))})

    return similarity


#: Up to so many candidate texts (8 bytes each) their keys are broadcast to fetch the texts; beyond it both sides are shuffled.
BROADCAST_KEYS = 500_000


def split_overlap(texts: DataFrame, splits: DataFrame, jaccard: float = 0.8, size: int = 3, train: str = "train", held_out: tuple[str, ...] = ("validation", "test")) -> tuple[DataFrame, DataFrame]:
    """Texts of held-out splits that the training split has too, wholly or almost.

    ``texts(key, record, text)`` and ``splits(record, split)``, one row a record, give ``(links,
    members)``. ``members(key, side, set_a, set_b, form)`` names each text's class of equal term sets
    and of equal letters and digits; ``links(set_a, set_b, train_a, train_b, jaccard, cosine)`` joins
    classes of term sets, held-out side first, whose sets of runs of ``size`` words reach ``jaccard``.
    Equal sets link with similarity 1. Texts equal in form share ``form``. A pair of copies needs no
    row of its own: it follows from both classes.

    The join is by cosine of unit vectors. Their terms weigh the same, as only then a Jaccard of
    ``j`` implies a cosine, of at least ``2j / (1 + j)``. Candidates share an indexed term, pass the
    greatest-weight bound and, at the term they share, the residual-norm bound, and are then computed
    exactly on whole texts. Null texts, records without a split, and splits that are neither take no
    part; a text without a word links to none (but may be equal in form); repeated rows of a key count
    once; an empty table gives empty results; other columns are ignored.
    """
    cosine = 2 * jaccard / (1 + jaccard)
    rows = texts.filter("text IS NOT NULL AND key IS NOT NULL").select("key", "record", "text")
    counts = term_counts(rows.select("text"), size)
    form = F.substring(F.unhex(F.sha2(canonical_text(F.col("text")), 256)), 1, 16)
    side = F.when(F.col("split") == train, "t").when(F.col("split").isin(*held_out), "e").alias("side")
    sides = splits.select("record", side).filter("side IS NOT NULL")
    signed = signatures(rows.withColumn("form", form), counts, size, cosine).join(sides, "record").drop("record")
    members = cut(signed)
    classes = members.filter("n > 0").groupBy("set_a", "set_b", "side").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("terms").alias("terms"))
    lists = classes.select("side", "key", "n", F.posexplode("terms").alias("at", "h"))

    def of(s: str) -> DataFrame:
        return lists.filter(F.col("side") == s).select("h", *(F.col(c).alias(f"{s}_{c}") for c in ("key", "n", "at")))

    # with w = 1/sqrt(n): min(n) * w * w, and w * w + the product of the norms after the shared term
    scale = F.sqrt(F.col("e_n").cast("double") * F.col("t_n"))
    bound = F.least(F.least("e_n", "t_n").cast("double"), 1 + F.sqrt((F.col("e_n") - F.col("e_at") - 1).cast("double") * (F.col("t_n") - F.col("t_at") - 1)))
    found = cut(of("e").join(of("t"), "h").filter(bound >= (cosine - _EPS) * scale).select("e_key", "t_key").distinct())
    wanted = found.select(F.col("e_key").alias("key")).unionByName(found.select(F.col("t_key").alias("key"))).distinct()
    if found.count() <= BROADCAST_KEYS // 2:
        wanted = F.broadcast(wanted)
    bodies = cut(rows.select("key", "text").join(wanted, "key").dropDuplicates(["key"]))
    pairs = found.join(bodies.select(F.col("key").alias("e_key"), F.col("text").alias("e_text")), "e_key").join(bodies.select(F.col("key").alias("t_key"), F.col("text").alias("t_text")), "t_key")
    near = pairs.withColumn("s", _similarity(size)("e_text", "t_text")).filter(F.col("s.jaccard") >= jaccard - 1e-12).select("e_key", "t_key", "s.jaccard", "s.cosine")
    sets = members.select("key", "side", "set_a", "set_b")
    ends = near.join(sets.filter("side = 'e'").select(F.col("key").alias("e_key"), "set_a", "set_b"), "e_key")
    ends = ends.join(sets.filter("side = 't'").select(F.col("key").alias("t_key"), F.col("set_a").alias("train_a"), F.col("set_b").alias("train_b")), "t_key")
    links = ends.select("set_a", "set_b", "train_a", "train_b", "jaccard", "cosine").distinct()
    return links, members.select("key", "side", "set_a", "set_b", "form")


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    er, tx = table(spark, d, "embedding_records"), table(spark, d, "embedding_texts")
    splits = er.groupBy(F.col("record_id").alias("record")).agg(F.max_by("split", "ingested_at").alias("split"), F.max_by("source_name", "ingested_at").alias("source_name"))
    return tx.select(F.col("text_key").alias("key"), F.col("record_id").alias("record"), "text"), splits


def _pairs(texts: DataFrame, splits: DataFrame) -> DataFrame:
    """Every pair (held-out key, training key) that links and classes stand for."""
    links, members = split_overlap(texts, splits)
    e = members.filter("side = 'e'").select(F.col("key").alias("e_key"), "set_a", "set_b", "form")
    t = members.filter("side = 't'").select(F.col("key").alias("t_key"), F.col("set_a").alias("train_a"), F.col("set_b").alias("train_b"), "form")
    near = links.join(e.drop("form"), ["set_a", "set_b"]).join(t.drop("form"), ["train_a", "train_b"]).select("e_key", "t_key")
    same = e.select("e_key", "form").join(t.select("t_key", "form"), "form").select("e_key", "t_key")
    return near.unionByName(same).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of texts across splits that are the same or almost."""
    p = _pairs(*_texts(spark, d))
    return p.select(F.least("e_key", "t_key").alias("key_a"), F.greatest("e_key", "t_key").alias("key_b"))


def p4_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Held-out texts that the training split has too, per split and source; partners are counted over classes, not listed."""
    texts, splits = _texts(spark, d)
    links, members = split_overlap(texts, splits)
    e, t = (members.filter(F.col("side") == s).groupBy("set_a", "set_b", "form").agg(F.count(F.lit(1)).alias("n")) for s in "et")
    t = t.withColumnRenamed("set_a", "train_a").withColumnRenamed("set_b", "train_b")
    held = e.select("set_a", "set_b", "form")
    sizes = t.groupBy("train_a", "train_b").agg(F.sum("n").alias("n"))
    near = links.select("set_a", "set_b", "train_a", "train_b")
    by_set = near.join(sizes, ["train_a", "train_b"]).groupBy("set_a", "set_b").agg(F.sum("n").alias("near"))
    # training texts of the same letters and digits whose term set is not linked already
    by_form = held.join(t, "form").join(near, ["set_a", "set_b", "train_a", "train_b"], "left_anti").groupBy("set_a", "set_b", "form").agg(F.sum("n").alias("same"))
    per_class = held.join(by_set, ["set_a", "set_b"], "left").join(by_form, ["set_a", "set_b", "form"], "left")
    per_class = per_class.select("set_a", "set_b", "form", (F.coalesce("near", F.lit(0)) + F.coalesce("same", F.lit(0))).alias("partners")).filter("partners > 0")
    hit = members.filter("side = 'e'").join(per_class, ["set_a", "set_b", "form"]).select("key", "partners")
    per = texts.select("key", "record").join(splits, "record").join(hit, "key", "left").filter("split IN ('validation', 'test')")
    return per.groupBy("split", "source_name").agg(F.count(F.lit(1)).alias("texts"), F.count("partners").alias("overlapping"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"))


_PAIRS = r"""WITH s AS (SELECT record_id, arg_max(split, ingested_at) AS split, arg_max(source_name, ingested_at) AS source_name FROM embedding_records GROUP BY 1),
t AS (SELECT text_key AS k, split, source_name, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS c, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM embedding_texts JOIN s USING (record_id) WHERE text IS NOT NULL AND split IN ('train', 'validation', 'test')),
g AS (SELECT k, split = 'train' AS train, c, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS g FROM t),
x AS (SELECT k, train, len(g) AS n, unnest(g) AS h FROM g),
j AS (SELECT a.k AS e, b.k AS t, count(*)::DOUBLE AS b, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.h = b.h AND NOT a.train AND b.train GROUP BY ALL),
p AS (SELECT e, t FROM j WHERE b / (na + nb - b) >= 0.8 UNION SELECT a.k, b.k FROM g a JOIN g b ON a.c = b.c AND NOT a.train AND b.train)
"""
SQL = {
    "p4_found": f"{_PAIRS} SELECT least(e, t) AS key_a, greatest(e, t) AS key_b FROM p",
    "p4_overlaps": f"""{_PAIRS}, h AS (SELECT e, count(*) AS n FROM p GROUP BY e), r AS (SELECT text_key AS k, split, source_name FROM embedding_texts JOIN s USING (record_id) WHERE split IN ('validation', 'test'))
SELECT split, source_name, count(*) AS texts, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs FROM r LEFT JOIN h ON e = k GROUP BY ALL""",
}
