"""A results folder as a table of its files, for audits against the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, folder, length, modified) of every file below a folder; path is relative to it, folder its first part ('' at the top). Bodies are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    full = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    at = folder.rstrip("/").removeprefix("file://") + "/"
    path = F.substring(full, F.instr(full, at) + len(at), F.lit(1_000_000))
    out = files.select(path.alias("path"), "length", F.col("modificationTime").alias("modified"))
    return out.select("path", F.when(F.contains("path", F.lit("/")), F.element_at(F.split("path", "/"), 1)).otherwise("").alias("folder"), "length", "modified")
