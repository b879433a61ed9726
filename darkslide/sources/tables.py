"""Parquet tables by name, with zone-less timestamps read as UTC instants where wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def utc(col: str) -> F.Column:
    """A TIMESTAMP_NTZ column as the instant it names in UTC (the session runs in UTC)."""
    return F.col(col).cast("timestamp")


def epoch(col: str) -> F.Column:
    """Whole seconds since the epoch of a zone-less UTC column."""
    return F.unix_timestamp(F.col(col).cast("timestamp"))
