"""Most similar vectors for every vector: shifted space-filling curves, neighbouring windows, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.cut import cut
from corvane.plans.skew import join_per_key
from corvane.session import table

#: Curves, projected dimensions, bits a dimension, and how far along each curve a vector looks either way. Beyond
#: ``FITTED`` vectors a third of the curves is added for every tenfold; the window never grows, so work is n log n.
CURVES, DIMS, BITS, WINDOW, FITTED = 32, 12, 5, 500, 90_000
#: Rows of one sorted range; its vectors are multiplied block by block.
RANGE_ROWS = 20_000
#: Single precision moves a cosine by less than this.
MARGIN = 1e-5


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``x`` (unsigned coordinates below 2^bits); dims * bits <= 63."""
    x = x.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:  # undo the rotations of each level, from the coarsest down
        p = q - one
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= one
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(b)) & one
    return key.view(np.int64)


def _projections(dim: int, curves: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    bases = np.stack([np.linalg.qr(rng.standard_normal((dim, dims)))[0] for _ in range(curves)])
    return bases.astype(np.float32), rng.random((curves, dims)).astype(np.float32)


def curve_keys(v: np.ndarray, spread: float, curves: int = CURVES, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """For unit vectors ``v`` the key on each curve: project, shift, scale to the grid, follow the curve."""
    bases, shifts = _projections(v.shape[1], curves, dims)
    out = np.empty((curves, len(v)), np.int64)
    for c in range(curves):
        u = (v @ bases[c]) / np.float32(6 * spread) + 0.5  # six deviations fill the grid
        grid = (u * (1 << (bits - 1)) + shifts[c] * (1 << (bits - 1))).clip(0, (1 << bits) - 1)
        out[c] = hilbert_keys(grid.astype(np.int64), bits)
    return out


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    m = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows of ``(key, vec)`` with exactly ``dim`` finite elements that are not all zero."""
    ok = (F.size("vec") == dim) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return vectors.filter(F.col("key").isNotNull() & F.col("vec").isNotNull()).filter(F.coalesce(ok, F.lit(False)))


def _points(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """``points(unit, key, copies)``, one a distinct unit vector under its least key, and ``members(key, representative)``."""
    raw = usable(vectors.select("key", "vec"), dim)

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = _unit(b.column(1), dim)
                flat = pa.array(u.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, u.size + 1, dim, dtype=np.int32)), flat)], ["key", "unit"])

    units = cut(raw.mapInArrow(normalise, "key long, unit array<float>"))
    points = cut(units.groupBy("unit").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies")))
    members = join_per_key(units.select("key", "unit"), points.select("unit", F.col("key").alias("representative"), "copies"), "unit", units.count(), "copies").select("key", "representative").distinct()
    return points, members


def _compare(t: pa.Table, dim: int, window: int, k: int | None, least: float, across: bool = False) -> pa.Table:
    """Pairs ``(key, other, sim)`` of rows at most ``window`` apart on their curve, in order of ``curve, pos, key``.

    With ``k`` each row's ``k`` most similar ones; without it each pair once that reaches ``least``.
    ``across`` compares only rows of different ``side``.
    """
    v = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float32).reshape(-1, dim)
    key, curve = t.column("key").to_numpy(), t.column("curve").to_numpy()
    side = t.column("side").to_numpy() if across else None
    m, step = len(v), 256
    left, right, sims = [], [], []
    for s in range(0, m, step):
        lo, hi, e = max(0, s - window), min(m, s + step + window), min(m, s + step)
        sim = v[s:e] @ v[lo:hi].T
        gap = np.arange(lo, hi)[None, :] - np.arange(s, e)[:, None]
        out = (gap == 0) | (np.abs(gap) > window) | (curve[s:e, None] != curve[None, lo:hi])
        if across:
            out |= side[s:e, None] == side[None, lo:hi]
        if k is None:
            a, b = np.nonzero(~out & (gap > 0) & (sim >= least))
            left.append(key[s:e][a])
            right.append(key[lo:hi][b])
            sims.append(sim[a, b])
            continue
        sim[out] = -2
        kk = min(k, hi - lo)
        top = np.argpartition(-sim, kk - 1, axis=1)[:, :kk]
        val = np.take_along_axis(sim, top, 1)
        ok = val > -2
        left.append(np.repeat(key[s:e], kk)[ok.ravel()])
        right.append(key[lo:hi][top][ok])
        sims.append(val[ok])
    cat = lambda x, d: np.concatenate(x) if x else np.empty(0, d)
    return pa.table({"key": cat(left, np.int64), "other": cat(right, np.int64), "sim": cat(sims, np.float32)})


def curve_pairs(points: DataFrame, dim: int, k: int | None, least: float = -1.0, curves: int | None = None, window: int | None = None) -> DataFrame:
    """``(key, other, sim)`` of ``points(key, unit)`` that are near each other on a curve, as in ``_compare``; a pair comes once a curve.

    Every curve sorts all points by their Hilbert key (range partitioning, so a task holds one range
    whatever the clusters' sizes). A range is compared in itself; only its first and last ``window``
    rows are shuffled again, to be compared across the border of two ranges.
    """
    n = points.count()
    spread = points.select(F.sqrt(F.avg(F.aggregate(F.zip_with("unit", "unit", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)) / dim)).first()[0] or 1.0
    curves = curves or round(CURVES * (1 + np.log10(max(1.0, n / FITTED)) / 3))
    window = window or WINDOW
    ranges = max(1, -(-n * curves // max(RANGE_ROWS, 8 * window)))
    schema = "curve int, pos long, key long, unit binary"
    names = ["curve", "pos", "key", "unit"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = np.ascontiguousarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), b.num_rows, [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            for c, pos in enumerate(curve_keys(flat, spread, curves)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), c, np.int32)), pa.array(pos), b.column(0), raw], names)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            yield from _compare(pa.Table.from_batches(held), dim, window, k, least).to_batches(max_chunksize=50_000)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        for rows, border, side in ((t.slice(0, window), me - 1, 1), (t.slice(max(0, t.num_rows - window)), me, 0)):
            if 0 <= border < ranges - 1:
                for name, x in (("border", border), ("side", side)):
                    rows = rows.append_column(name, pa.array(np.full(rows.num_rows, x, np.int32)))
                yield from rows.to_batches(max_chunksize=4000)

    def border(t: pa.Table) -> pa.Table:
        return _compare(t.sort_by([("curve", "ascending"), ("pos", "ascending"), ("key", "ascending")]), dim, window, k, least, across=True)

    rows = points.select("key", "unit").mapInArrow(keyed, schema).repartitionByRange(ranges, "curve", "pos", "key").sortWithinPartitions("curve", "pos", "key")
    pairs = "key long, other long, sim float"
    return rows.mapInArrow(inside, pairs).unionByName(rows.mapInArrow(ends, f"{schema}, border int, side int").groupBy("border").applyInArrow(border, pairs))


def nearest_vectors(vectors: DataFrame, k: int = 10, dim: int = 64, curves: int | None = None, window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``k`` most similar vectors of every usable vector of ``vectors(key, vec)``.

    Result ``(neighbours, members)``: ``neighbours(key, other, cosine, rank)`` over distinct
    directions, ``members(key, representative)`` with each usable key's representative, the least
    key with bit-equal unit vector: a group of copies of any size is one point of every curve.
    Windows hold vectors in single precision, so ``cosine`` is right to six digits. Ties go to the
    least key. Each vector is compared with ``window`` vectors either way on each curve, keeps the
    ``k`` best of each, and of all of them the ``k`` best.

    Null vectors or keys, null or non-finite elements, other dimensions and zero vectors are left
    out; repeated rows of a key with the same vector count once; an empty table gives empty results;
    other columns are ignored.
    """
    points, members = _points(vectors, dim)
    pairs = curve_pairs(points, dim, k, curves=curves, window=window)
    ranked = pairs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "other"))).alias("all"))  # at most 2 * curves * k entries
    ranked = ranked.withColumn("ids", F.transform("all", lambda x: x["other"])).withColumn("best", F.slice(F.array_distinct("ids"), 1, k))
    few = ranked.select("key", "all", "ids", F.posexplode("best").alias("rank", "other"))
    sim = -F.get("all", F.array_position("ids", F.col("other")).cast("int") - 1)["s"]
    return few.select("key", "other", sim.cast("double").alias("cosine"), (F.col("rank") + 1).alias("rank")), members


def similar_vectors(vectors: DataFrame, least: float = 0.95, dim: int = 64, curves: int | None = None, window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links ``(key, other, cosine)``, ``key < other``, between distinct directions with a cosine of at least ``least``, and ``members`` as above.

    A vector may have any number of partners: all that its windows hold come out, none by rank.
    Cosines are computed in double precision. In a group of more vectors than a window holds that are
    all this similar, links can be missing; each curve sees the group in another order.
    """
    points, members = _points(vectors, dim)
    near = curve_pairs(points, dim, None, least - MARGIN, curves, window)
    links = near.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()
    of = usable(vectors.select("key", "vec"), dim).dropDuplicates(["key"])
    return exact_cosine(of, links).filter(F.col("cosine") >= least).select(F.col("key_a").alias("key"), F.col("key_b").alias("other"), "cosine"), members


def exact_cosine(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(key_a, key_b)`` with the cosine of their vectors in double precision."""
    v = vectors.select("key", F.transform("vec", lambda x: x.cast("double")).alias("v"))
    a, b = v.select(F.col("key").alias("key_a"), F.col("v").alias("a")), v.select(F.col("key").alias("key_b"), F.col("v").alias("b"))

    def dot(x: str, y: str) -> F.Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)

    return pairs.join(a, "key_a").join(b, "key_b").select("key_a", "key_b", (dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))).alias("cosine"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedding_vectors").select(F.col("vec_key").alias("key"), "vec")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Ten most similar vectors of each distinct vector; copies stand behind their representative in ``p2_members``.

    The ten neighbours of any key are its representative's other members, at cosine 1, then the
    members of its representative's neighbours by rank, cut after ten.
    """
    few, _ = nearest_vectors(_vectors(spark, d))
    return few.select("key", "other", F.round("cosine", 6).alias("cosine"), "rank")


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """Every usable vector's key with the representative that stands for it in ``p2_neighbours``; its own where it has no copy."""
    _, members = nearest_vectors(_vectors(spark, d))
    return members.select(F.col("key").alias("vec_key"), "representative")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors with a cosine of 0.95 or more."""
    links, members = similar_vectors(_vectors(spark, d))
    m = cut(members)
    pairs = links.join(m.select(F.col("representative").alias("key"), F.col("key").alias("x")), "key").select("x", "other").join(m.select(F.col("representative").alias("other"), F.col("key").alias("y")), "other").select("x", "y")
    copies = m.alias("p").join(m.alias("q"), F.col("p.representative") == F.col("q.representative")).filter("p.key < q.key").select(F.col("p.key").alias("x"), F.col("q.key").alias("y"))
    return pairs.unionByName(copies).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


SQL = {
    "p2_found": """WITH v AS (SELECT vec_key AS k, vec::DOUBLE[] AS v FROM embedding_vectors WHERE len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL)) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
u AS (SELECT k, v, sqrt(list_dot_product(v, v)) AS n FROM v)
SELECT a.k AS key_a, b.k AS key_b FROM u a JOIN u b ON a.k < b.k AND list_dot_product(a.v, b.v) >= 0.95::DOUBLE * a.n * b.n"""
}
