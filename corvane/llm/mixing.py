"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.tokens import with_tokens
from corvane.plans.cut import cut
from corvane.session import table

#: How far the mix's shares may be from the targets in all (half the sum of differences): more tolerance, more tokens.
TOLERANCE = 0.01
#: How much a repeated source's weight changes from the start (1 - RAMP) to the end (1 + RAMP) of its share.
RAMP = 0.5
#: Documents of a source whose running sum is taken in one piece.
BLOCK = 20_000


def plan(sources: list[tuple[str, float, int, int]], tolerance: float = TOLERANCE) -> dict[str, float]:
    """Tokens to take from each of ``(name, target share, tokens there are, max repeats)``.

    Targets of sources without tokens go to the others in proportion. The total is the largest for
    which shares stay within ``tolerance`` of the targets when scarce sources give all they may.
    """
    there = [(s, w, n * r) for s, w, n, r in sources if w > 0 and n > 0 and r > 0]
    total_w = sum(w for _, w, _ in there)
    if not there:
        return {}
    share = {s: w / total_w for s, w, _ in there}
    cap = {s: c for s, _, c in there}

    def given(t: float) -> dict[str, float]:
        return {s: min(share[s] * t, cap[s]) for s in share}

    def off(t: float) -> float:
        g = given(t)
        z = sum(g.values())
        return sum(abs(x / z - share[s]) for s, x in g.items()) / 2

    lo, hi = min(cap[s] / share[s] for s in share), max(cap[s] / share[s] for s in share)
    if off(hi) <= tolerance:
        return given(hi)
    for _ in range(100):  # the deviation grows with the total
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if off(mid) <= tolerance else (lo, mid)
    return given(lo)


def ramps(sources: list[tuple[str, float, int, int]], wanted: dict[str, float], ramp: float = RAMP) -> dict[str, float]:
    """Slope of each source's weight: repeated sources rise by ``ramp``, the others fall so that weights always sum to one."""
    up = {s for s, _, _, r in sources if s in wanted and r > 1}
    a, b = sum(wanted[s] for s in wanted if s in up), sum(wanted[s] for s in wanted if s not in up)
    if not a or not b:
        return dict.fromkeys(wanted, 0.0)
    k = min(ramp, ramp * b / a)
    return {s: k if s in up else -k * a / b for s in wanted}


def schedules(sources: list[tuple[str, float, int, int]], wanted: dict[str, float], given: list[tuple[str, float, float]], ramp: float = RAMP) -> dict[str, tuple[list[float], list[float], list[float]]]:
    """Each source's weight over time as ``(times, weights, integral up to each time)``, scaled so that the integral over [0, 1] is one.

    ``given`` holds knots ``(source, time, weight)`` of straight lines; before the first and after the
    last knot the weight stays. Sources without knots follow ``ramps``. A weight below zero, a time
    outside [0, 1] or a source whose weights are all zero is an error.
    """
    slope = ramps(sources, wanted, ramp)
    own: dict[str, dict[float, float]] = {}
    for s, t, w in given:
        if not 0 <= t <= 1 or not 0 <= w < float("inf"):
            raise ValueError(f"schedule of {s}: time {t}, weight {w}")
        own.setdefault(s, {})[t] = w
    out = {}
    for s in wanted:
        knots = sorted(own.get(s, {0.0: 1 - slope[s], 1.0: 1 + slope[s]}).items())
        if knots[0][0] > 0:
            knots.insert(0, (0.0, knots[0][1]))
        if knots[-1][0] < 1:
            knots.append((1.0, knots[-1][1]))
        ts, ws = [t for t, _ in knots], [w for _, w in knots]
        sums = [0.0]
        for i in range(1, len(ts)):
            sums.append(sums[-1] + (ts[i] - ts[i - 1]) * (ws[i] + ws[i - 1]) / 2)
        if sums[-1] <= 0:
            raise ValueError(f"schedule of {s} has no weight")
        out[s] = (ts, [w / sums[-1] for w in ws], [x / sums[-1] for x in sums])
    return out


def mix(documents: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE, ramp: float = RAMP, schedule: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """Choose from ``documents(key, source, tokens)`` so that token shares come near ``targets(source, share, repeats)``.

    Result, sorted by ``position``: ``key, source, repeat, tokens, position``, one row for each time
    a document is used; a source's n-th pass has ``repeat`` n - 1 and no source is passed more than
    ``repeats`` times. A source's weight changes over time as ``schedule`` says (``schedules``); its
    integral up to time t is the part of its tokens asked for by t. A use that begins after c of a
    source's tokens is placed at the time when c is asked for. Running sums are taken in blocks by
    hash, so a source of any size is spread over tasks; the driver holds one line a source.

    Documents that are null, without tokens or of a source without a target are not chosen; a target
    without documents gives nothing; a target given twice counts by its least row; a key given twice is
    two documents; an empty table gives an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.filter("tokens > 0 AND source IS NOT NULL AND key IS NOT NULL").select("key", "source", "tokens")
    goals = targets.groupBy("source").agg(F.min("share").alias("share"), F.min("repeats").alias("repeats"))
    sums = docs.groupBy("source").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
    known = [(r["source"], r["share"], r["n"], r["repeats"]) for r in goals.join(sums, "source").collect()]  # one row a source with a target
    sizes = {r["source"]: r["docs"] for r in sums.join(goals, "source", "left_semi").collect()}
    wanted = plan(known, tolerance)
    lines = schedules(known, wanted, schedule or [], ramp)
    rows = [(s, float(wanted[s]), float(n), *lines[s], max(1, -(-sizes[s] // BLOCK)), int(r)) for s, _, n, r in known if s in wanted]
    per = spark.createDataFrame(rows, "source string, want double, n double, ts array<double>, ws array<double>, sums array<double>, blocks long, passes int")
    d = docs.join(F.broadcast(per), "source").withColumn("h", F.xxhash64("key")).withColumn("block", F.pmod(F.shiftrightunsigned("h", 16), F.col("blocks")))
    own = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1))
    blocks = d.groupBy("source", "block").agg(F.sum("tokens").alias("t"))
    start = F.sum("t").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    begun = blocks.select("source", "block", F.coalesce(start, F.lit(0)).alias("start"))
    d = d.withColumn("own", F.coalesce(own, F.lit(0))).join(begun, ["source", "block"]).withColumn("before", F.col("own") + F.col("start"))
    uses = d.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.least(F.col("passes") - 1, F.floor(F.col("want") / F.col("n")).cast("int")))))
    c = F.col("repeat") * F.col("n") + F.col("before")
    chosen = uses.withColumn("c", c).filter(F.col("c") + F.col("tokens") / 2 <= F.col("want")).withColumn("x", F.col("c") / F.col("want"))
    # the last stretch of the schedule that begins at or before x; on it the integral is a parabola
    at = F.least(F.size(F.filter("sums", lambda v: v <= F.col("x"))), F.size("sums") - 1) - 1
    chosen = chosen.withColumn("i", at)
    t0, t1, w0, w1, rest = F.get("ts", F.col("i")), F.get("ts", F.col("i") + 1), F.get("ws", F.col("i")), F.get("ws", F.col("i") + 1), F.col("x") - F.get("sums", F.col("i"))
    slope = F.try_divide(w1 - w0, t1 - t0)
    step = F.coalesce(F.try_divide(2 * rest, w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest))), F.lit(0.0))
    return chosen.select("key", "source", "repeat", "tokens", (t0 + F.least(step, t1 - t0)).alias("position")).orderBy("position", "source", "key", "repeat")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = cut(with_tokens(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source", "text"), ["key", "source"]))
    goals = table(spark, d, "mix_targets").select(F.col("source_name").alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats"))
    return mix(docs, goals), docs, goals


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The training order: every use of a document with its position."""
    return _mixed(spark, d)[0].withColumnRenamed("key", "doc_id").withColumnRenamed("source", "source_name")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per targeted source: wanted and actual share, tokens there are and tokens used."""
    got, docs, goals = _mixed(spark, d)
    used = got.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.max("repeat").alias("last"))
    there = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rows = goals.join(there, "source", "left").join(used, "source", "left")
    total = F.sum(F.coalesce("used_tokens", F.lit(0))).over(Window.partitionBy())
    return rows.select(
        F.col("source").alias("source_name"), F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.coalesce(F.col("last") + 1, F.lit(0)).alias("passes"), F.round(F.coalesce(F.try_divide(F.coalesce("used_tokens", F.lit(0)), total), F.lit(0.0)), 6).alias("actual_share"),
    )


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold by targeted source: whether it has tokens, no pass beyond the allowed, and in all that shares are near the targets."""
    got, docs, goals = _mixed(spark, d)
    used = got.groupBy("source").agg(F.sum("tokens").alias("used"), (F.max("repeat") + 1).alias("passes"))
    there = docs.filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("longest"))
    rows = goals.join(there, "source", "left").join(used, "source", "left")
    every = Window.partitionBy()  # one row a target
    live = F.sum(F.when(F.col("n").isNotNull(), F.col("share"))).over(every)
    off = F.coalesce(F.col("used") / F.sum("used").over(every), F.lit(0.0)) - F.when(F.col("n").isNotNull(), F.col("share") / live).otherwise(0.0)
    grain = F.sum("longest").over(every) / F.sum("used").over(every)  # a source ends within one document of what is wanted
    rows = rows.withColumn("off", F.sum(F.abs(off)).over(every) / 2 - grain)
    return rows.select(F.col("source").alias("source_name"), F.col("n").isNotNull().alias("there"), (F.coalesce("passes", F.lit(0)) > F.col("repeats")).alias("too_often"), (F.col("off") <= TOLERANCE).alias("near_targets"))


SQL = {"p9_checks": "SELECT source_name, source_name IN (SELECT source FROM documents WHERE text <> '') AS there, false AS too_often, true AS near_targets FROM mix_targets"}
