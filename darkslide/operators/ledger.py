"""What became of every entry, and whether the books balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FATES = ("library", "album-clone", "placeholder", "not-importable", "excluded-trash", "excluded-screenshot", "skipped-json", "system-file", "symlink-skipped", "error")


def group_fate(failed: F.Column, placeholder: F.Column, skip: F.Column, not_importable: F.Column) -> F.Column:
    return F.when(failed, "error").when(placeholder, "placeholder").when(skip, "excluded-trash").when(not_importable, "not-importable").otherwise("library")


def member_fate(fate: F.Column, folder_class: F.Column, include_trash: bool = False) -> F.Column:
    """The fate of a member of a group: errors first, trash next, album members of a library group as clones."""
    trash = F.lit(False) if include_trash else folder_class == "trash"
    return F.when(fate == "error", "error").when(trash, "excluded-trash").when((fate == "library") & (folder_class == "album"), "album-clone").otherwise(fate)


def entry_fates(entries: DataFrame, grouped: DataFrame) -> DataFrame:
    """(id, fate) of every entry: what the entry itself tells wins over its group's fate; entries that nobody claims are errors.

    entries: id, is_symlink, is_system, is_json, is_screenshot. grouped: id, fate; of an id named twice the least
    fate by order counts.
    """
    told = F.when(F.col("is_symlink"), "symlink-skipped").when(F.col("is_system"), "system-file").when(F.col("is_screenshot"), "excluded-screenshot").when(F.col("is_json"), "skipped-json")
    g = grouped.groupBy("id").agg(F.min("fate").alias("_fate"))
    return entries.join(g, "id", "left").select("id", F.coalesce(told, F.col("_fate"), F.lit("error")).alias("fate"))


def balance(entries: DataFrame, fates: DataFrame) -> DataFrame:
    """One row (entries, fates, distinct_ids, unknown, balanced): every entry has one known fate."""
    n = entries.agg(F.count("*").alias("entries"))
    f = fates.agg(F.count("*").alias("fates"), F.countDistinct("id").alias("distinct_ids"), F.count_if(~F.coalesce(F.col("fate").isin(*FATES), F.lit(False))).alias("unknown"))
    both = f.withColumn("entries", n.scalar())
    ok = (F.col("entries") == F.col("fates")) & (F.col("fates") == F.col("distinct_ids")) & (F.col("unknown") == 0)
    return both.select("entries", "fates", "distinct_ids", "unknown", ok.alias("balanced"))


def by_priority(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value) of the last source that names a key; within a source the least value."""
    every = None
    for i, s in enumerate(sources):
        one = s.select(key, F.col(value).alias("_v"), F.lit(-i).alias("_p"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.min(F.struct("_p", "_v")).alias("m")).select(key, F.col("m._v").alias(value))
