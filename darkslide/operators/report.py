"""Counts that sum a run up, in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAT_LIMIT = 4 * 1024**3 - 1


def rollup(df: DataFrame, keys: dict[str, F.Column]) -> DataFrame:
    """(metric, key, value): how often each key of each metric occurs, in one pass; null keys are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), c.cast("string").alias("key")) for m, c in keys.items())))
    return df.select(pairs.alias("p")).select("p.metric", "p.key").where("key is not null").groupBy("metric", "key").agg(F.count("*").alias("value"))


def size_estimate(groups: DataFrame, size: str, clones: F.Column) -> DataFrame:
    """One row (bytes): the first members' sizes and their copies, a tenth added in whole bytes."""
    n = F.coalesce(F.sum(F.col(size) * (1 + clones)), F.lit(0)).cast("bigint")
    return groups.agg(n.alias("n")).select((F.col("n") + F.expr("n div 10")).alias("bytes"))


def too_large(files: DataFrame, size: str, kind: str) -> DataFrame:
    """One row (files): how many exceed what FAT takes, WebM counted half as large again."""
    return files.agg(F.count_if(F.when(F.col(kind) == "webm", F.col(size) * 3 / 2).otherwise(F.col(size)) > FAT_LIMIT).alias("files"))


def first_errors(df: DataFrame, message: str, order: str, limit: int) -> DataFrame:
    """The first `limit` messages by order, and one line that counts the rest. The limit is the feature: a report lists no more."""
    every = df.where(F.col(message).isNotNull()).select(F.col(order).alias("ord"), F.col(message).alias("message"))
    rest = every.agg((F.count("*") - limit).alias("n")).where("n > 0").select(F.lit(None).cast(every.schema["ord"].dataType).alias("ord"), F.concat(F.lit("and "), "n", F.lit(" more")).alias("message"))
    return every.orderBy("ord").limit(limit).unionByName(rest)


def exit_code(missing_parts: F.Column, errors: F.Column, tag_errors: F.Column) -> F.Column:
    """0 fine, 2 the input is not whole, 3 files failed, 4 only tags failed."""
    return F.when(missing_parts > 0, 2).when(errors > 0, 3).when(tag_errors > 0, 4).otherwise(0)


def identity(counts: DataFrame, parts: list[str]) -> DataFrame:
    """counts (one row) with `balanced`: unique is the sum of the parts."""
    return counts.withColumn("balanced", F.col("unique") == reduce(lambda a, b: a + b, (F.col(p) for p in parts)))
