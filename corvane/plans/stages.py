"""Pipelines of named stages: order, cache keys, resumption from stage tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from corvane.functions.canonical import write_json


@dataclass
class Stage:
    """A named step over the outputs of others."""

    name: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    config: dict = field(default_factory=dict)
    version: str = "1"


def order(stages: list[Stage]) -> list[Stage]:
    """Dependencies first; a cycle or an unknown dependency is an error."""
    by = {s.name: s for s in stages}
    if len(by) != len(stages):
        raise ValueError("stage names must differ")
    out: list[Stage] = []
    mark: dict[str, int] = {}

    def visit(n: str) -> None:
        if n not in by:
            raise ValueError(f"unknown dependency {n}")
        if mark.get(n) == 1:
            raise ValueError(f"cycle at {n}")
        if n not in mark:
            mark[n] = 1
            for x in by[n].needs:
                visit(x)
            mark[n] = 2
            out.append(by[n])

    for s in stages:
        visit(s.name)
    return out


def cache_key(stage: Stage, inputs: dict[str, str]) -> str:
    """SHA-256 over sorted input keys, configuration and version."""
    return hashlib.sha256(write_json({"stage": stage.name, "inputs": {k: inputs[k] for k in sorted(inputs)}, "config": stage.config, "version": stage.version}).encode()).hexdigest()


def run(spark: SparkSession, stages: list[Stage], root: str, sources: dict[str, str] | None = None) -> dict[str, tuple[str, bool]]:
    """Run what has no finished table yet; ``{stage: (path, reused)}``. A stage's table is its cache key's folder.

    Spark's committer leaves ``_SUCCESS`` in finished tables only, so a lost run is simply run again.
    """
    keys: dict[str, str] = dict(sources or {})
    out: dict[str, tuple[str, bool]] = {}
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for s in order(stages):
        key = cache_key(s, {n: keys[n] for n in s.needs} | (sources or {}))
        path = f"{root}/{s.name}-{key[:32]}"
        p = fs_path(f"{path}/_SUCCESS")
        done = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        if not done:
            s.run(*(spark.read.parquet(out[n][0]) for n in s.needs), **s.config).write.mode("overwrite").parquet(path)
        keys[s.name] = key
        out[s.name] = (path, done)
    return out
