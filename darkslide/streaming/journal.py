"""The journal as a stream: its latest records kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from darkslide.operators.journal import latest
from darkslide.sources.journal import records


def lines(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """New journal files of a folder, line by line, with the time, name and block they come from."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return raw.select("value", F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("origin"))


def _batch_records(batch: DataFrame) -> DataFrame:
    """Records of one batch; `line` orders them by file time and place in the file."""
    return records(batch.select("value", F.struct("origin.at", "origin.file", "origin.block", F.monotonically_increasing_id().alias("n")).alias("line")))


def keep_latest(stream: DataFrame, target: str, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """A query that keeps the latest record of every id in `target`, a folder of numbered versions.

    A batch is merged with the version before it and written as its own version, so a batch that is run again after
    a failure writes the same rows to the same place. Old versions but the last `keep` are removed. Read the result
    with `current`.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _version(spark, target, number)
        batch = _batch_records(batch)
        both = batch if old is None else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/v={old}"))
        latest(both, "id", "line").select(*batch.columns).write.mode("overwrite").parquet(f"{target}/v={number}")
        _forget(spark, target, number - keep)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, target: str) -> list[int]:
    fs, p = _fs(spark, target)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p)]
    return sorted(int(x.getName()[2:]) for x in found if x.getName().startswith("v=") and fs.exists(_fs(spark, f"{x}/_SUCCESS")[1]))


def _version(spark: SparkSession, target: str, before: int) -> int | None:
    return max((v for v in _versions(spark, target) if v < before), default=None)


def _forget(spark: SparkSession, target: str, upto: int) -> None:
    for v in _versions(spark, target):
        if v <= upto:
            fs, p = _fs(spark, f"{target}/v={v}")
            fs.delete(p, True)


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The latest records as of the last finished batch, None before the first."""
    v = max(_versions(spark, target), default=None)
    return None if v is None else spark.read.parquet(f"{target}/v={v}")


def stage_counts(stream: DataFrame, time: str, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Records by stage and hour of a stream with a time column; records later than `late` are left out of windows already closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "stage").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "stage", "n")
