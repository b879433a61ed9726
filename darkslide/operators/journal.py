"""The resume journal: latest records, what is left to do, and audits of what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("staged", "tagged", "placing", "placed", "cloned")


def latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key by order; records without a key are left out. Combines before the shuffle, so a key may hold any share of the log."""
    cols = [c for c in records.columns if c not in (key, order)]
    best = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(order, *cols), order).alias("r"))
    return best.select(key, "r.*")


def pending(groups: DataFrame, last: DataFrame, key: str) -> DataFrame:
    """groups with `todo` (all, albums) of those not finished: cloned groups are done; placed ones lack only their albums."""
    state = last.select(key, F.col("stage").alias("_stage"))
    out = groups.join(state, key, "left").where(F.coalesce(F.col("_stage") != "cloned", F.lit(True)))
    return out.withColumn("todo", F.when(F.col("_stage") == "placed", "albums").otherwise("all")).drop("_stage")


def missing_files(last: DataFrame, listing: DataFrame) -> DataFrame:
    """(path): paths of finished records and their album copies that the listing (path) does not have."""
    done = last.where(F.col("stage").isin("placed", "cloned"))
    own = done.select("path").where("path <> ''")
    albums = done.select(F.explode("albums").alias("path")).where("path <> ''")
    return own.unionByName(albums).distinct().join(listing.select("path").distinct(), "path", "left_anti")


def tag_year(text: F.Column) -> F.Column:
    """The year that a date tag begins with, 1800 to 2100."""
    y = F.substring(text, 1, 4).try_cast("int")
    return F.when(y.between(1800, 2100), y)


def year_mismatches(files: DataFrame) -> DataFrame:
    """files (id, folder, dto, creation_date, kind) whose year folder is not the year of their tags; raw and unknown kinds are not asked, files without a readable year are listed with tag_year null."""
    asked = files.where(F.rlike("folder", F.lit("^[0-9]{4}$")) & ~F.col("kind").isin("raw", "cr3", "unknown", "avi", "bmp", "mpg", "wmv"))
    y = F.coalesce(tag_year(F.col("dto")), tag_year(F.col("creation_date")))
    out = asked.select("id", "folder", y.alias("tag_year"))
    return out.where(F.col("tag_year").isNull() | (F.col("tag_year") != F.col("folder").cast("int")))
