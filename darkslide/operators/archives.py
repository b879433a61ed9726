"""Questions about the parts of an export and the roots of its entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.functions import folders

# Fixed value: the shape of part names.
PART_PATTERN = r"(?i)takeout-(\d{8}T\d{6}Z).*?-(\d+)\.zip$"


def part_of(path: F.Column) -> F.Column:
    """(export_id, part) that the base name of an archive tells, else null."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(F.rlike(base, F.lit(PART_PATTERN)), F.struct(F.regexp_extract(base, PART_PATTERN, 1).alias("export_id"), F.regexp_extract(base, PART_PATTERN, 2).try_cast("int").alias("part")))


def missing_in_sequence(df: DataFrame, group: str, number: str) -> DataFrame:
    """(group, number): numbers from 1 to the greatest of each group that no row has. A missing last number cannot be seen; null numbers and groups are left out."""
    have = df.where(F.col(group).isNotNull() & (F.col(number) >= 1)).select(group, number).distinct()
    top = have.groupBy(group).agg(F.max(number).alias("_top"))
    every = top.select(group, F.explode(F.sequence(F.lit(1).cast(df.schema[number].dataType), F.col("_top"))).alias(number))
    return every.join(have, [group, number], "left_anti")


def fallback_roots(entries: DataFrame, prefix: str = "Takeout/") -> DataFrame:
    """(root, n_json, n_other, used): top folders under the prefix that hold sidecars and media. One is used only if it alone qualifies; more than one is ambiguous and none is used."""
    parts = F.split("entry_name", "/")
    inside = entries.where(F.startswith("entry_name", F.lit(prefix)) & (F.size(parts) >= 3))
    by = inside.groupBy(F.get(parts, F.lit(1)).alias("root")).agg(F.count_if("is_json").alias("n_json"), F.count_if(~F.col("is_json")).alias("n_other"))
    fit = by.where("n_json > 0 and n_other > 0")
    only = fit.agg(F.count("*").alias("_n"))
    # one line against the few roots that qualify
    return fit.withColumn("used", F.lit(1) == only.scalar())


def under_fallback_root(entries: DataFrame, prefix: str = "Takeout/") -> DataFrame:
    """entries with `folder` and `name` below the one fallback root, if there is one; no rows where none or several qualify.

    entries: entry_name, is_json. A folder that is a word and a year counts as that year's folder.
    """
    root = fallback_roots(entries, prefix).where("used").select("root")
    parts = F.split("entry_name", "/")
    inside = entries.where(F.startswith("entry_name", F.lit(prefix)) & (F.size(parts) >= 3)).withColumn("_root", root.scalar())
    inside = inside.where((F.get(parts, F.lit(1)) == F.col("_root")) & (F.element_at(parts, -1) != ""))
    folder = folders.norm_folder(F.when(F.size(parts) > 3, F.get(parts, F.lit(2))).otherwise(""))
    year = folders.generic_year(folder)
    folder = F.when(year.isNotNull(), F.concat(F.lit("Photos from "), year.cast("string"))).otherwise(folder)
    return inside.withColumns({"folder": folder, "name": F.element_at(parts, -1)}).drop("_root")
