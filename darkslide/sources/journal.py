"""The resume journal as JSON lines; a torn line is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, sha string, stage string, path string, year string, name string, error string, albums array<string>"


def records(lines: DataFrame) -> DataFrame:
    """Records of journal lines (value, and `line` where the order is known), unreadable ones left out."""
    keep = [c for c in lines.columns if c != "value"]
    out = lines.select(*keep, F.from_json("value", SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return out.where("r is not null and r._bad is null and r.id is not null").select(*keep, *(f"r.{c.split()[0]}" for c in SCHEMA.split(", ")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of a journal folder or file. `line` orders them within one file: the file and the place in it."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("line"))
    return records(lines)
