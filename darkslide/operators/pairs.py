"""Stills and videos that belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.functions.kinds import IMAGES, VIDEOS


def by_content_id(groups: DataFrame) -> DataFrame:
    """(image, video) of groups (id, kind, content_id) where exactly two share an identifier, one image and one video."""
    is_i, is_v = F.col("kind").isin(*IMAGES), F.col("kind").isin(*VIDEOS)
    one = groups.where("content_id is not null and content_id <> ''").groupBy("content_id")
    one = one.agg(F.count("*").alias("n"), F.max(F.when(is_i, F.col("id"))).alias("image"), F.max(F.when(is_v, F.col("id"))).alias("video"))
    return one.where("n = 2 and image is not null and video is not null").select("image", "video")


def by_stem(groups: DataFrame) -> DataFrame:
    """(image, video) of groups (id, kind, folder, stem, ord): exactly one video and an image share folder and stem.

    The image is the last HEIC, else the first image. A second video blocks the pair.
    """
    is_i, is_v = F.col("kind").isin(*IMAGES), F.col("kind").isin(*VIDEOS)
    agg = groups.where("stem is not null").groupBy("folder", "stem").agg(
        F.count_if(is_v).alias("nv"), F.max(F.when(is_v, F.col("id"))).alias("video"),
        F.max_by("id", F.when(F.col("kind") == "heic", F.col("ord"))).alias("heic"), F.min_by("id", F.when(is_i, F.col("ord"))).alias("first"),
    )
    return agg.where("nv = 1").select(F.coalesce("heic", "first").alias("image"), "video").where("image is not null")


def live_pairs(groups: DataFrame) -> DataFrame:
    """(image, video, how): pairs by identifier, then by stem among groups that are not paired yet."""
    first = by_content_id(groups).withColumn("how", F.lit("content-id"))
    taken = first.select(F.explode(F.array("image", "video")).alias("id"))
    second = by_stem(groups.join(taken, "id", "left_anti")).withColumn("how", F.lit("stem"))
    return first.unionByName(second)


def raw_pairs(groups: DataFrame, paired: DataFrame) -> DataFrame:
    """(raw, still): exactly one raw file and one JPEG or HEIC that is in no pair share folder and stem; they share a name, nothing else. paired: id."""
    free = groups.join(paired, "id", "left_anti")
    r, s = F.col("kind").isin("raw", "cr3"), F.col("kind").isin("jpeg", "heic")
    agg = free.groupBy("folder", "stem").agg(F.count_if(r).alias("nr"), F.count_if(s).alias("ns"), F.max(F.when(r, F.col("id"))).alias("raw"), F.max(F.when(s, F.col("id"))).alias("still"))
    return agg.where("nr = 1 and ns = 1").select("raw", "still")


def propagate(dated: DataFrame, pairs: DataFrame) -> DataFrame:
    """dated (id, t, source, ...) with times handed over within pairs: a half dated only by its name, or not at all, takes the other half's time with source `live`."""
    both = pairs.select(F.col("image").alias("id"), F.col("video").alias("_other")).unionByName(pairs.select(F.col("video").alias("id"), F.col("image").alias("_other")))
    other = dated.select(F.col("id").alias("_other"), F.col("t").alias("_t"), F.col("source").alias("_source"))
    weak = lambda s, t: t.isNull() | s.isin("filename", "filename-date")
    out = dated.join(both, "id", "left").join(other, "_other", "left")
    take = F.col("_other").isNotNull() & weak(F.col("source"), F.col("t")) & ~weak(F.col("_source"), F.col("_t"))
    new = {"t": F.when(take, F.col("_t")).otherwise(F.col("t")), "source": F.when(take, "live").otherwise(F.col("source"))}
    return out.withColumns(new).drop("_other", "_t", "_source")


def shared_identifier(image: F.Column, video: F.Column) -> F.Column:
    """An identifier for a pair, the same on every run, in the shape of a UUID."""
    h = F.upper(F.substring(F.sha2(F.concat_ws("+", image, video), 256), 1, 32))
    cut = lambda i, n: F.substring(h, i, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
