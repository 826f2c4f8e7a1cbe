"""Session construction and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "corvane", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, Arrow, AQE).

    Nothing in the operators depends on ``local[*]``: on a cluster pass no master and
    let spark-submit decide.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | (conf or {})).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the data set's tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
