"""Groups of copies: a cheap key first, a hash only where it is needed, and the member that stands for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkslide.functions.folders import folder_class


def confirmed_groups(df: DataFrame, cheap: list[str], content_hash: F.Column, order: str) -> DataFrame:
    """df with group_rank, group_ord and members: rows of one content are one group.

    Rows that share the cheap key are split by their hash; rows alone with their key are never hashed. Within a
    key, groups are ranked by hash, the smallest first (rank 1); group_ord is the least `order` of the group. A null
    hash (unreadable content) makes a group of its own after all others. The cheap key is counted before the rows
    are, so that a key that holds many rows is one line there.
    """
    shared = df.groupBy(*cheap).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    flagged = df.join(shared.withColumn("_shared", F.lit(True)), cheap, "left")
    flagged = flagged.withColumn("_hash", F.when(F.col("_shared"), F.coalesce(content_hash, F.concat(F.lit("~"), F.col(order).cast("string")))).otherwise(""))
    groups = flagged.groupBy(*cheap, "_hash").agg(F.count("*").alias("members"), F.min(order).alias("group_ord"))
    groups = groups.withColumn("group_rank", F.row_number().over(Window.partitionBy(*cheap).orderBy("_hash")))
    return flagged.join(groups, [*cheap, "_hash"]).drop("_shared", "_hash")


def canonical_score(folder: F.Column) -> F.Column:
    """How well a member stands for its group: 0 in a photo folder of the library, 1 elsewhere in it, 3 in an album, 4 in the trash."""
    kind = folder_class(folder)
    photo = F.contains(F.lower(folder), F.lit("photo")) | F.startswith(folder, F.lit("Фото")) | F.contains(folder, F.lit("Foto"))
    return F.when((kind == "library") & photo, 0).when(kind == "library", 1).when(kind == "album", 3).otherwise(4)


def canonical(members: DataFrame, group: list[str], folder: str, order: str) -> DataFrame:
    """(group..., canon, n): the member of least score, the first by order among equals."""
    best = F.min(F.struct(canonical_score(F.col(folder)).alias("score"), F.col(order).alias("ord")))
    return members.groupBy(*group).agg(best["ord"].alias("canon"), F.count("*").alias("n"))


def greedy_distinct(times: F.Column, slack: int) -> F.Column:
    """Times kept in the order given: each unless it lies within slack of one kept before. Depends on the order, as it must."""
    return F.aggregate(times, F.array().cast("array<bigint>"), lambda kept, t: F.when(F.exists(kept, lambda k: F.abs(k - t) <= slack), kept).otherwise(F.array_append(kept, t)))


def distinct_times(df: DataFrame, group: str, time: str, order: str, slack: int) -> DataFrame:
    """(group, n): how many distinct times the rows of a group have, greedily by order; null times do not count.

    The fold needs a group in one row. Times are first thinned where that cannot change the count: of equal times
    only the first matters.
    """
    first = df.where(F.col(time).isNotNull()).groupBy(group, F.col(time).alias("_t")).agg(F.min(order).alias("_o"))
    kept = first.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_o", "_t"))).alias("_ts"))
    return kept.select(group, F.size(greedy_distinct(F.transform("_ts", lambda x: x["_t"].cast("bigint")), slack)).cast("bigint").alias("n"))


def with_distinct_times(df: DataFrame, group: str, time: str, order: str, slack: int, least: int) -> DataFrame:
    """(group): groups whose rows have at least `least` distinct times, greedily by order.

    Each round takes the first time by order that is more than slack off all taken before, by an aggregate that combines
    before it is shuffled, so a group may hold any share of the rows; null times do not count.
    """
    rows = df.where(F.col(time).isNotNull()).select(group, F.col(time).cast("bigint").alias("_t"), F.col(order).alias("_o"))
    found = rows.select(group).distinct()
    for i in range(least):
        found = rows.groupBy(group).agg(F.min_by("_t", "_o").alias("_k"))
        if i + 1 < least:
            rows = rows.join(found, group).where(F.abs(F.col("_t") - F.col("_k")) > slack).drop("_k")
    return found.select(group)


def placeholders(members: DataFrame, group: str, time: str, order: str, size: str, slack: int = 60, least: int = 3, small: int = 16384) -> DataFrame:
    """(group): at least three members with three distinct times whose first member is small, as images that stand in for lost files are."""
    many = members.groupBy(group).agg(F.count("*").alias("_n"), F.min_by(size, order).alias("_size")).where((F.col("_n") >= least) & (F.col("_size") <= small))
    return with_distinct_times(members.join(many.select(group), group, "left_semi"), group, time, order, slack, least)


def conflicts(members: DataFrame, group: str, time: str, order: str, canon: str, slack: int = 60) -> DataFrame:
    """(group, ord, time): the first member whose time is more than slack off that of the canonical member; at most one per group."""
    own = members.where(F.col(order) == F.col(canon)).select(group, F.col(time).alias("_canon_t"))
    off = members.join(own, group).where(F.abs(F.col(time) - F.col("_canon_t")) > slack)
    return off.groupBy(group).agg(F.min(order).alias("ord"), F.min_by(time, order).alias("time"))


def names_in_many_groups(members: DataFrame, key: F.Column, group: F.Column) -> DataFrame:
    """(key, groups): names, by their key, that occur in more than one group. Pairs are made distinct before they are counted."""
    pairs = members.select(key.alias("key"), group.alias("_group")).distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("groups")).where("groups > 1")
