"""Duplicates hidden by formatting: partition-merged Bloom filters, then exact grouping of possible repeats."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.plans.cut import cut, drop, new_path, read_cut
from corvane.plans.skew import join_per_key
from corvane.session import table

#: Bits of the filter for each row, and probes. 16 bits and 4 probes let through about one single row in two million.
BITS_PER_ROW, PROBES = 16, 4
#: Bits of one filter (8 MB broadcast). More rows than 2^26 / 16 are cut into ranges of hashes, each with a filter of its own.
MAX_BITS = 1 << 26
SEGMENT = 1 << 19  # bits that are merged as one row

_OTHER = re.compile(r"[\W_]+")


def canonical_text(text: F.Column) -> F.Column:
    """Letters and digits (Unicode L and N) lower-cased in order, all else left out."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def _squeeze(text: str) -> str:
    # \w of Python's re: L, N, underscore and a few marks; the marks go by isalnum
    return "".join(c for c in _OTHER.sub("", text) if c.isalnum()).lower()


def _no_constant(name: str) -> None:
    raise ValueError(name)


class _Number(tuple):
    """A JSON number by value: sign, digits without outer zeros, exponent."""


def _number(text: str) -> _Number:
    try:
        sign, digits, exponent = Decimal(text).as_tuple()
    except ArithmeticError:  # an exponent beyond what decimals hold: by its writing
        return _Number(("n", text.lower()))
    plain = "".join(map(str, digits)).lstrip("0")
    short = plain.rstrip("0")
    return _Number(("n", sign, short, exponent + len(plain) - len(short)) if short else ("n", 0))


def _fields(payload: str | None) -> str | None:
    try:
        o = json.loads(payload, parse_constant=_no_constant, parse_int=_number, parse_float=_number)
    except (ValueError, TypeError, RecursionError):
        return None
    if not isinstance(o, dict):
        return None

    def form(v: object) -> object:
        if isinstance(v, dict):
            return sorted(([k.lower(), form(x)] for k, x in v.items()), key=repr)
        if isinstance(v, list):
            return [form(x) for x in v]
        return _squeeze(v) if isinstance(v, str) else v

    return json.dumps(form(o), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_fields(payload: pd.Series) -> pd.Series:
    """A JSON object's fields, names without case and in order, string values squeezed; null for broken JSON."""
    return payload.map(_fields)


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    a = h.view(np.uint64)
    b = (a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
    return np.concatenate([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def _packed(bits: np.ndarray) -> tuple[bool, bytes]:
    """A segment as packed bits, or as the places of its bits where those are fewer bytes."""
    at = np.flatnonzero(bits)
    return (True, np.packbits(bits).tobytes()) if 4 * len(at) > len(bits) // 8 else (False, at.astype(np.uint32).tobytes())


def _unpacked(dense: bool, data: bytes, segment: int) -> np.ndarray:
    if dense:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(segment, bool)
    bits[np.frombuffer(data, np.uint32)] = True
    return np.packbits(bits)


def repeat_filter(hashes: DataFrame, n_rows: int, max_bits: int = MAX_BITS) -> tuple[np.ndarray, int]:
    """The packed filter of hashes seen at least twice in ``hashes(x long)``, and its number of bits.

    Every task fills a once-seen and a twice-seen filter; merging ORs both and adds to the second
    what two once-seen filters share. Whatever is repeated, within tasks or across them, has all
    its bits in the result. A task with few rows sends the places of its bits, so the bytes shuffled
    follow the rows and not the number of tasks.
    """
    bits = min(max_bits, 1 << max(13, int(n_rows * BITS_PER_ROW - 1).bit_length()))
    segment = min(SEGMENT, bits)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for b in batches:
            at, n = np.unique(_positions(b.column(0).to_numpy(zero_copy_only=False), bits), return_counts=True)
            twice[at] |= once[at] | (n > 1)
            once[at] = True
        for s in range(bits // segment):
            o, t = (x[s * segment : (s + 1) * segment] for x in (once, twice))
            if o.any():
                (do, o), (dt, t) = _packed(o), _packed(t)
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([do]), pa.array([o]), pa.array([dt]), pa.array([t])], ["seg", "dense_once", "once", "dense_twice", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for s, do, o, dt, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                o, t = _unpacked(do, o, segment), _unpacked(dt, t, segment)
                kept[s] = [kept[s][0] | o, kept[s][1] | t | (kept[s][0] & o)] if s in kept else [o, t]
        for s, (_, t) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([t.tobytes()])], ["seg", "twice"])

    filled = hashes.mapInArrow(fill, "seg long, dense_once boolean, once binary, dense_twice boolean, twice binary")
    merged = filled.repartition(max(1, min(16, bits // segment)), "seg").mapInArrow(merge, "seg long, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():  # at most max_bits / 8 bytes in all
        out[r[0] * segment // 8 : (r[0] + 1) * segment // 8] = np.frombuffer(r[1], np.uint8)
    return out, bits


MARKED = "tbl string, key long, h binary"


def format_duplicates(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows(tbl, key, canonical)`` to ``(tbl, key, representative, copies)``, one row per input row.

    The representative is the least key with the same canonical form in the same table. Only rows
    that the merged filter calls possible repeats are shuffled, by SHA-256 of the form; all others
    come out as singles with one copy. Forms are cut into ranges of their hashes with about
    ``max_bits / 16`` rows each, one folder a range, so every range reads its rows alone and has a
    filter of bounded size that is as selective as any other's, however many rows there are.

    A null form (null text, broken JSON) is left out; an empty form is a form like any other; an
    empty table gives an empty result; a key given twice with the same form counts twice. A form
    held by a third of all rows is a partial aggregate and meets its rows by broadcast; its range
    is larger by those rows, which set no further bits.
    """
    spark = rows.sparkSession
    ranges = max(1, -(-rows.count() * BITS_PER_ROW // max_bits))  # a count of rows, so no form is computed for it
    digest = F.unhex(F.sha2(F.concat_ws("\x1f", "tbl", "canonical"), 256))
    slim = rows.filter("canonical IS NOT NULL").select("tbl", "key", digest.alias("h"))
    slim = cut(slim.withColumn("hash_range", F.pmod(F.shiftrightunsigned(F.xxhash64("h"), 40), F.lit(ranges)).cast("int")), by="hash_range")
    sizes = {r[0]: r[1] for r in slim.groupBy("hash_range").count().collect()}  # one row a range
    path = new_path(spark)
    for r in sorted(sizes):
        part = slim.filter(F.col("hash_range") == r).drop("hash_range")
        packed, bits = repeat_filter(part.select(F.xxhash64("h").alias("x")), sizes[r], max_bits)
        _mark(part, packed, bits).write.mode("append").parquet(path)
    marked = read_cut(spark, path, MARKED) if sizes else spark.createDataFrame([], MARKED)
    drop(slim)
    alone = marked.filter("h IS NULL").select("tbl", "key", F.col("key").alias("representative"), F.lit(1).cast("long").alias("copies"))
    maybe = marked.filter("h IS NOT NULL")
    classes = maybe.groupBy("h").agg(F.min("key").alias("representative"), F.count(F.lit(1)).alias("copies"))
    return alone.unionByName(join_per_key(maybe, classes, "h", maybe.count(), "copies").select("tbl", "key", "representative", "copies"))


def _mark(part: DataFrame, packed: np.ndarray, bits: int) -> DataFrame:
    """``part(tbl, key, h)`` without the hash of rows that are surely single."""
    shared = part.sparkSession.sparkContext.broadcast(packed)  # at most max_bits / 8 bytes

    @F.pandas_udf("boolean")
    def possible(x: pd.Series) -> pd.Series:
        at = _positions(x.to_numpy(), bits)
        f = shared.value
        hit = (f[at >> 3] >> (7 - (at & 7))) & 1
        return pd.Series(hit.reshape(PROBES, -1).all(axis=0))

    return part.select("tbl", "key", F.when(possible(F.xxhash64("h")), F.col("h")).alias("h"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    tx, im = table(spark, d, "embedding_texts"), table(spark, d, "import_records")
    return tx.select(F.lit("embedding_texts").alias("tbl"), F.col("text_key").alias("key"), canonical_text(F.col("text")).alias("canonical")).unionByName(
        im.select(F.lit("import_records").alias("tbl"), F.col("row_key").alias("key"), canonical_fields("payload").alias("canonical"))
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each later row of a class with the class's least key."""
    got = format_duplicates(_rows(spark, d))
    return got.filter("copies > 1 AND key <> representative").select("tbl", F.col("representative").alias("key_a"), F.col("key").alias("key_b"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One row per class: its least key and how many copies there were."""
    got = format_duplicates(_rows(spark, d))
    return got.filter("key = representative").select("tbl", "key", "copies")


def p3_stale_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Per class size: classes whose rows carry differing or missing text_hash values."""
    got = format_duplicates(_rows(spark, d).filter("tbl = 'embedding_texts'"))
    tx = table(spark, d, "embedding_texts").select(F.col("text_key").alias("key"), "text_hash")
    per = got.join(tx, "key").groupBy("representative").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("text_hash").alias("hashes"), F.count_if(F.coalesce(F.col("text_hash"), F.lit("")) == "").alias("missing"))
    return per.groupBy("copies").agg(F.count(F.lit(1)).alias("classes"), F.count_if(F.col("hashes") > 1).alias("with_differing_hashes"), F.count_if(F.col("missing") > 0).alias("with_missing_hashes"))


_CLASSES = r"""WITH t AS (SELECT 'embedding_texts' AS tbl, text_key AS k, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS c FROM embedding_texts),
j AS (SELECT row_key, payload FROM import_records WHERE json_valid(payload)),
f AS (SELECT row_key, payload, unnest(json_keys(payload)) AS name FROM j),
g AS (SELECT row_key, lower(name) || '=' || CASE WHEN json_type(payload -> name) = 'NULL' THEN 'null' ELSE 's:' || lower(regexp_replace(payload ->> name, '[^\p{L}\p{N}]+', '', 'g')) END AS x FROM f),
i AS (SELECT 'import_records' AS tbl, row_key AS k, string_agg(x, chr(31) ORDER BY x) AS c FROM g GROUP BY row_key),
a AS (SELECT *, min(k) OVER (PARTITION BY tbl, c) AS m, count(*) OVER (PARTITION BY tbl, c) AS n FROM (SELECT * FROM t UNION ALL SELECT * FROM i) WHERE c IS NOT NULL)
"""
SQL = {
    "p3_found": f"{_CLASSES} SELECT tbl, m AS key_a, k AS key_b FROM a WHERE k <> m",
    "p3_collapsed": f"{_CLASSES} SELECT tbl, k AS key, n AS copies FROM a WHERE k = m",
    "p3_stale_hashes": r"""WITH c AS (SELECT lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS c, count(*) AS copies, count(DISTINCT text_hash) AS hashes, count(*) FILTER (WHERE coalesce(text_hash, '') = '') AS missing FROM embedding_texts WHERE text IS NOT NULL GROUP BY 1)
SELECT copies, count(*) AS classes, count(*) FILTER (WHERE hashes > 1) AS with_differing_hashes, count(*) FILTER (WHERE missing > 0) AS with_missing_hashes FROM c GROUP BY 1""",
}
