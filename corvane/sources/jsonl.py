"""JSON lines: reading with line numbers and byte offsets, three error modes, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.canonical import canonical_json
from corvane.functions.text import trim_all
from corvane.plans.cut import cut


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSONL files: ``(path, line, byte_offset, value)``; blank lines are counted but left out.

    Files of any size are read in splits. Lines and bytes are numbered within a split and moved on by
    those of the file's splits before it, of which there is one row each.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = cut(raw.withColumn("bytes", F.octet_length("value").cast("long") + 1))
    w = Window.partitionBy("path", "block").orderBy("at")
    done = w.rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("bytes_before"))
    own = rows.withColumn("n", F.row_number().over(w)).withColumn("off", F.coalesce(F.sum("bytes").over(done), F.lit(0)))
    text = F.regexp_replace("value", "\r$", "")
    out = own.join(starts, ["path", "block"]).select("path", (F.col("lines_before") + F.col("n")).alias("line"), (F.col("bytes_before") + F.col("off")).alias("byte_offset"), text.alias("value"))
    return out.filter(trim_all(F.col("value")) != "")


def parse_lines(lines: DataFrame, mode: str = "fail") -> DataFrame:
    """Mark lines that are no JSON. ``fail`` raises with line and byte, ``mark`` keeps them with ``error``, ``drop`` leaves them out."""
    bad = F.try_parse_json("value").isNull()
    if mode == "fail":
        msg = F.concat(F.lit("malformed JSON at line "), F.col("line").cast("string"), F.lit(", byte "), F.col("byte_offset").cast("string"))
        return lines.withColumn("value", F.when(bad, F.raise_error(msg)).otherwise(F.col("value")))
    marked = lines.withColumn("error", F.when(bad, "JSONL_MALFORMED"))
    return marked if mode == "mark" else marked.filter("error IS NULL").drop("error")


def write_lines(df: DataFrame, path: str, canonical: bool = False, overwrite: bool = False) -> None:
    """One JSON object a row; ``canonical`` sorts keys and writes numbers as ECMAScript does. An existing path is an error unless ``overwrite``."""
    value = F.to_json(F.struct(*df.columns))
    df.select((canonical_json(value) if canonical else value).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def decode_preferences(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference records of parsed lines, and what was lost: ``(line, code)``. Needs version, id, prompt, two distinct answers, known split."""
    s = "preferenceRecordVersion string, id string, prompt string, chosen string, rejected string, split string"
    d = parse_lines(lines, "mark").withColumn("r", F.from_json("value", s))
    code = (
        F.when(F.col("error").isNotNull(), "PREFERENCE_JSON").when(F.coalesce("r.preferenceRecordVersion", F.lit("")) != "1.0.0", "PREFERENCE_VERSION").when(F.coalesce("r.id", F.lit("")) == "", "PREFERENCE_ID")
        .when(F.col("r.chosen").isNull() | F.col("r.rejected").isNull() | (F.col("r.chosen") == F.col("r.rejected")), "PREFERENCE_PAIR").when(~F.coalesce(F.col("r.split").isin("train", "validation", "test"), F.lit(False)), "PREFERENCE_SPLIT")
    )
    d = d.withColumn("code", code)
    return d.filter("code IS NULL").select("line", "r.*"), d.filter("code IS NOT NULL").select("line", "code")
