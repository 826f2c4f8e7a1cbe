"""Structured Streaming: JSONL intake, paid-call deduplication, lease recovery, ordered events, rate windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_lines(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines of new files as rows of ``schema``; a line that is no JSON has a null row and its text in ``value``."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return raw.select("value", F.from_json("value", schema).alias("r")).select("value", "r.*")


def paid_once(calls: DataFrame, identity: str = "identity", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first call of each identity within the watermark."""
    return calls.withWatermark(ts, late).dropDuplicatesWithinWatermark([identity])


def rate_stream(calls: DataFrame, ts: str = "ts", every: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Calls a window, emitted when its watermark passes."""
    return calls.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("calls")).select(F.col("w.start").alias("start"), "calls")


def recover_leases(attempts: DataFrame, lease_ms: int = 60_000) -> DataFrame:
    """Running attempts ``(record, status)`` that do not finish within their lease come out as ``failed_retryable``; finished ones as they are."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"record": [key[0]], "status": ["failed_retryable"], "attempt": [n]})
            return
        done = None
        for b in batches:
            n += int((b["status"] == "running").sum())
            finished = b.loc[b["status"] != "running", "status"]
            if len(finished):
                done = finished.iloc[-1]
        if done is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"record": [key[0]], "status": [done], "attempt": [n]})
        else:
            state.update((n,))
            state.setTimeoutDuration(lease_ms)

    return attempts.groupBy("record").applyInPandasWithState(step, "record string, status string, attempt int", "attempt int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def gapless(events: DataFrame, start: int = 0) -> DataFrame:
    """Events ``(run, sequence)`` in arrival order that are not the next of their run: ``(run, sequence, expected)``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        want = state.get[0] if state.exists else start
        out = []
        for b in batches:
            for s in b["sequence"].sort_values():
                if s != want:
                    out.append((key[0], int(s), want))
                want = int(s) + 1
        state.update((want,))
        yield pd.DataFrame(out, columns=["run", "sequence", "expected"])

    return events.groupBy("run").applyInPandasWithState(step, "run string, sequence long, expected long", "next long", "append", GroupStateTimeout.NoTimeout)
