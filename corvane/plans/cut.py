"""Cutting lineage with tables in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Unset, a local master gets a folder of its own; any other master is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; with ``by`` in one folder a value, so a filter on it reads that alone.

    Unlike ``checkpoint()`` this computes the plan once and keeps column pruning and
    statistics; a lost executor costs only the tasks it ran. ``drop`` removes it early,
    otherwise it goes when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark)
    w = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1")
    (w.partitionBy(by) if by else w).parquet(path)
    return read_cut(spark, path, df.schema)


def new_path(spark: SparkSession) -> str:
    """Where a table may be written that goes when the driver ends."""
    path = f"{shared_folder(spark)}/corvane-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def read_cut(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table under a path of ``new_path``."""
    out = spark.read.schema(schema).parquet(path)
    out._corvane_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the table behind a frame that ``cut`` returned."""
    path = getattr(df, "_corvane_path", None)
    if path:
        _remove(path)


def _remove(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is temporary anyway
        pass


@atexit.register
def _clean() -> None:
    for path in list(_made):
        _remove(path)
