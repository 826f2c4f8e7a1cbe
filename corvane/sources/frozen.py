"""Frozen data sets, content-addressed blobs, file manifests: hashes on write, hashes again on read."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.jsonl import write_lines


def _digest(df: DataFrame) -> tuple[str, int]:
    """Order-free digest of rows: SHA-256 over 4096 sorted bucket digests, each over its rows' sorted hashes; and the row count."""
    h = df.select(F.sha2("value", 256).alias("h")).withColumn("b", F.substring("h", 1, 3))
    counts = h.groupBy("b", "h").agg(F.count(F.lit(1)).alias("n"))  # repeated rows are one line
    buckets = counts.groupBy("b").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "h", "n")))), 256).alias("d"), F.sum("n").alias("n")).orderBy("b").collect()
    return hashlib.sha256("".join(r["d"] for r in buckets).encode()).hexdigest(), sum(r["n"] for r in buckets)


#: Up to so many lineage roots also stand in the manifest itself.
LISTED = 100_000


def freeze(df: DataFrame, path: str, lineage: str | None = None, overwrite: bool = False) -> dict:
    """Write ``records`` (canonical JSONL), ``lineage_roots`` and ``manifest`` under ``path``: hash, rows, lineage roots.

    All sorted distinct roots are a table (parquet, column ``root``); the manifest has its path beside
    the records, count and digest. ``lineageRoots`` lists them where there are at most ``LISTED``, else it is null.
    """
    spark = df.sparkSession
    write_lines(df, f"{path}/records", canonical=True, overwrite=overwrite)
    digest, n = _digest(spark.read.text(f"{path}/records"))
    manifest = {"version": "1.0.0", "recordsHash": digest, "recordCount": n, "lineageRoots": []}
    if lineage is not None:
        roots = df.select(F.col(lineage).alias("root")).filter("root IS NOT NULL").distinct().orderBy("root")
        roots.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/lineage_roots")
        roots = spark.read.parquet(f"{path}/lineage_roots")
        hashed, count = _digest(roots.select(F.col("root").cast("string").alias("value")))
        listed = sorted(r[0] for r in roots.collect()) if count <= LISTED else None
        manifest |= {"lineageRoots": listed, "lineageRootsPath": "lineage_roots", "lineageRootsHash": hashed, "lineageRootCount": count}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(f"{path}/manifest")
    return manifest


def verify_frozen(spark: SparkSession, path: str) -> dict:
    """The manifest, if the records and the lineage roots still have its hashes and counts; else an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if (manifest["recordsHash"], manifest["recordCount"]) != _digest(spark.read.text(f"{path}/records")):
        raise ValueError(f"frozen records under {path} were changed")
    if at := manifest.get("lineageRootsPath"):
        roots = spark.read.parquet(f"{path}/{at}").select(F.col("root").cast("string").alias("value"))
        if (manifest["lineageRootsHash"], manifest["lineageRootCount"]) != _digest(roots):
            raise ValueError(f"frozen lineage roots under {path} were changed")
    return manifest


def freeze_gates(records: DataFrame, issues: DataFrame, membership: DataFrame) -> list[str]:
    """What forbids freezing: errors, records the clusters do not cover, clusters across splits."""
    out = []
    if issues.limit(1).count():
        out.append("VALIDATION_ERRORS")
    if records.join(membership, "key", "left_anti").limit(1).count():
        out.append("DEDUPE_COVERAGE")
    if records.join(membership, "key").groupBy("leader").agg(F.count_distinct("split").alias("n")).filter("n > 1").limit(1).count():
        out.append("CLUSTER_CROSSES_SPLITS")
    return out


def inventory(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Files under a folder: ``(name, bytes, sha256)``, names relative to ``base``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", F.concat(F.lit("^.*?"), F.lit((base or path).rstrip("/").replace(".", r"\.")), F.lit("/")), F.lit(""))
    return f.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_inventory(manifest: DataFrame, files: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """Problems ``(name, problem)`` of files against ``manifest(name, bytes, sha256)``: missing, changed, unsafe name, required."""
    m = manifest.select("name", F.col("bytes").alias("mb"), F.col("sha256").alias("mh"))
    j = m.join(files, "name", "left")
    unsafe = F.col("name").startswith("/") | F.col("name").contains("..")
    problem = F.when(unsafe, "unsafe").when(F.col("sha256").isNull(), "missing").when((F.col("bytes") != F.col("mb")) | (F.col("sha256") != F.col("mh")), "changed")
    out = j.select("name", problem.alias("problem")).filter("problem IS NOT NULL")
    if required:
        want = manifest.sparkSession.createDataFrame([(x,) for x in required], "name string")
        out = out.unionByName(want.join(manifest, "name", "left_anti").withColumn("problem", F.lit("required")))
    return out


def put_blobs(df: DataFrame, path: str) -> DataFrame:
    """Store ``df(content binary)`` by hash, partitioned by its first two digits; returns the distinct keys."""
    b = df.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))
    b.write.mode("append").partitionBy("prefix").parquet(path)
    return b.select("sha256")


def get_blobs(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Blobs of ``keys(sha256)``; one whose content has another hash raises."""
    b = spark.read.parquet(path).join(keys.select("sha256").distinct(), "sha256").dropDuplicates(["sha256"])
    return b.select("sha256", F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("corrupt blob "), F.col("sha256"))).cast("binary")).alias("content"))


def read_vector_shard(spark: SparkSession, path: str, bytes_: int, bound: int) -> bytes:
    """A vector shard of an exact size within a bound."""
    if bytes_ > bound:
        raise ValueError("shard is larger than the bound")
    rows = spark.read.format("binaryFile").load(path).filter(F.col("length") == bytes_).select("content").take(1)
    if not rows:
        raise ValueError("shard has another size")
    return bytes(rows[0][0])
