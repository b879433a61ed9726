"""The whole plan of an export: from archive entries to groups, times, names, fates and a report. Nothing is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.functions import dates, folders, kinds, names, text
from darkslide.operators import archives as archives_
from darkslide.operators import dating, dedup, ledger, pairs, placing, report, sidecars, spatial, timestamps, zones
from darkslide.session import cut
from darkslide.sources import archives


@dataclass(frozen=True)
class Options:
    """What a user may choose; now is given, so that a plan is the same whenever it is made."""

    now: int
    default_zone: str | None = None
    include_trash: bool = False
    exclude_screenshots: bool = False


@dataclass
class Plan:
    entries: DataFrame
    matches: DataFrame
    groups: DataFrame
    pairs: DataFrame
    placement: DataFrame
    fates: DataFrame
    report: DataFrame
    raw_pairs: DataFrame
    near_names: DataFrame
    conflicts: DataFrame


def with_roots(index: DataFrame) -> DataFrame:
    """Directory rows with folder, name and flags; entries outside the root folder are left out. An unsafe path stops the query."""
    index = index.where("entry_name is not null")
    safe = F.assert_true(folders.safe_path(F.col("entry_name")), F.concat(F.lit("unsafe path in archive: "), "entry_name"))
    json = F.endswith(F.lower("name"), F.lit(".json"))
    every = index.where(safe.isNull())
    e = every.withColumn("s", folders.split_root(F.col("entry_name"))).where("s is not null").select("*", "s.folder", "s.name").drop("s")
    if e.isEmpty():  # a root folder in a language that is not listed
        e = archives_.under_fallback_root(every.withColumn("is_json", F.endswith(F.lower("entry_name"), F.lit(".json")))).drop("is_json")
    e = e.withColumns({"folder": folders.norm_folder(text.nfc(F.col("folder"))), "is_json": json, "is_system": folders.is_system(F.col("entry_name")), "ord": F.struct("zip_ord", "entry_ord")})
    return e.withColumns({"class": folders.folder_class(F.col("folder")), "id": F.concat_ws("#", "zip_path", F.col("entry_ord").cast("string"))})


def with_groups(media: DataFrame) -> DataFrame:
    """media with group_id: size and CRC, and where contents differ that share both, 12 digits of the hash for all but the least. Only files that share both are read."""
    shared = media.groupBy("size", "crc32").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    read = cut(archives.hashes(media.join(shared, ["size", "crc32"], "left_semi")), "hashes")
    grouped = dedup.confirmed_groups(media.join(read, "id", "left"), ["size", "crc32"], F.col("content_hash"), "ord")
    plain = F.format_string("%d:%08x", "size", "crc32")
    split = F.concat_ws(":", plain, F.substring(F.ltrim(F.col("content_hash"), F.lit("~")), 1, 12))
    return grouped.withColumn("group_id", F.when(F.col("group_rank") == 1, plain).otherwise(split)).drop("content_hash", "members", "group_ord", "group_rank")


def camera_tags(tags: DataFrame) -> DataFrame:
    """(id, wall, tag_offset, content_id) of tags (zip_path, entry_ord, dto, offset_time, content_identifier) of media; what is no time or offset is null."""
    offset = timestamps.parse_offset(F.col("offset_time"))
    offset = F.when(dates.valid_offset(offset), offset)
    return tags.select(entry_id(), dates.exif_wall(F.col("dto")).alias("wall"), offset.alias("tag_offset"), F.nullif("content_identifier", F.lit("")).alias("content_id")).dropDuplicates(["id"])


def entry_id() -> F.Column:
    return F.concat_ws("#", "zip_path", F.col("entry_ord").cast("string")).alias("id")


def zone_offsets(groups: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, zone_offset): the offset of the zone in which the place of a group (id, lat, lon, t) lies, at its time; of several zones the first by name.

    regions: as in spatial.points_in_regions, with zone.
    """
    spark = groups.sparkSession
    inside = spatial.points_in_regions(groups.select(F.col("id").alias("point_id"), "lat", "lon"), regions)
    named = inside.join(regions.select("region_id", "zone"), "region_id").groupBy(F.col("point_id").alias("id")).agg(F.min("zone").alias("zone"))
    zone = timestamps.known_zone(spark, F.col("zone"))
    return groups.join(named, "id").where("t is not null").select("id", timestamps.zone_offset_s(zone, F.col("t")).alias("zone_offset"))


def plan(index: DataFrame, bodies: DataFrame, options: Options, tags: DataFrame | None = None, regions: DataFrame | None = None, taken: DataFrame | None = None) -> Plan:
    """The plan of an export.

    index: rows of the archives source in its directory mode; bodies: rows of its content mode for the sidecars.
    tags: what the cameras wrote (zip_path, entry_ord, dto, offset_time, content_identifier); regions: shapes with
    their zone; taken: (dir, name) of files that are placed already. Without them no time comes from a camera, no zone
    from a place, and every name is free.
    """
    now, none = F.lit(options.now), F.lit(None).cast("bigint")
    e = cut(with_roots(index), "entries")
    shot = ~F.col("is_json") & kinds.is_screenshot(F.col("name")) if options.exclude_screenshots else F.lit(False)
    e = e.withColumn("is_screenshot", shot)
    said = bodies.select("zip_path", "entry_ord", sidecars.parse(F.col("content").cast("string")).alias("sc")).where("sc is not null")
    side = e.where("is_json and not is_system").where(~folders.is_album_json(F.col("name"))).join(said, ["zip_path", "entry_ord"])
    media = e.where("not is_json and not is_system and not is_symlink and not is_screenshot")
    asked = media if options.include_trash else media.where("class <> 'trash'")
    matches = cut(sidecars.match(asked, side), "matches")
    members = with_groups(media).join(matches.select(F.col("media_id").alias("id"), "sidecar_id"), "id", "left").join(side.select(F.col("id").alias("sidecar_id"), "sc"), "sidecar_id", "left")
    members = cut(members, "members")
    first = F.struct(dedup.canonical_score(F.col("folder")).alias("score"), "ord")
    has = F.col("sc").isNotNull()
    g = members.groupBy("group_id", "size", "crc32").agg(
        F.count("*").alias("n_members"), F.min("ord").alias("ord"), F.min_by(F.struct("id", "folder", "name", "class", "zip_path", "entry_ord"), first).alias("canon"),
        F.coalesce(F.min_by("sc", F.when(has, first)), F.min_by("sc", F.when(has, F.col("ord")))).alias("sc"), F.min_by("folder", "ord").alias("first_folder"),
    )
    copies = dedup.placeholders(members.select("group_id", F.col("sc.taken").alias("taken"), "ord", "size"), "group_id", "taken", "ord", "size")
    g = g.join(copies.withColumn("placeholder", F.lit(True)), "group_id", "left").withColumn("placeholder", F.coalesce("placeholder", F.lit(False)))
    heads = archives.heads(g.select("canon.*"))
    g = g.join(heads.withColumnRenamed("id", "_head_of"), F.col("canon.id") == F.col("_head_of"), "left").drop("_head_of")
    if tags is None:
        g = g.withColumns({"wall": none, "tag_offset": none, "content_id": F.lit(None).cast("string")})
    else:
        t = camera_tags(tags).withColumnRenamed("id", "_tags_of")
        g = g.join(t, F.col("canon.id") == F.col("_tags_of"), "left").drop("_tags_of")
    seen = F.coalesce("head", F.lit(b""))
    g = g.withColumns({"kind": kinds.kind(seen, F.col("canon.name")), "motion": F.coalesce(F.col("motion"), F.lit(False)) | F.endswith(F.lower("canon.name"), F.lit(".mp"))})
    g = cut(g.drop("head"), "contents")
    if regions is None:
        g = g.withColumn("zone_offset", none)
    else:
        at = F.when(dates.taken_in_bounds(F.col("sc.taken"), now), F.col("sc.taken")).otherwise(F.col("sc.creation"))
        zoned = zone_offsets(g.select(F.col("group_id").alias("id"), "sc.lat", "sc.lon", at.alias("t")), regions)
        g = g.join(zoned.withColumnRenamed("id", "group_id"), "group_id", "left")
    when = dating.resolve(
        dating.from_sidecar(F.col("sc.taken"), F.col("sc.creation"), F.col("zone_offset"), F.col("tag_offset"), F.col("wall"), now),
        dating.from_tags(F.col("wall"), F.col("tag_offset"), now), dating.from_name(F.col("canon.name"), now),
    )
    stem = text.fold_key(text.live_stem(F.col("canon.name")))
    flat = g.withColumn("w", when).select(
        "group_id", F.col("group_id").alias("id"), "ord", "n_members", "size", "canon", "kind", "sc", "placeholder", "motion", "content_id", "w.t", "w.offset_s", "w.source", "w.tz_step",
        F.col("canon.folder").alias("folder"), stem.alias("stem"),
    )
    # what later stages read several times is written once
    flat = cut(flat, "groups")
    fit = flat.where("not placeholder")
    paired = cut(pairs.live_pairs(fit), "pairs")
    raws = cut(pairs.raw_pairs(fit, paired.select(F.explode(F.array("image", "video")).alias("id"))), "raw-pairs")
    dated = pairs.propagate(flat, paired)
    numbered = dated.withColumn("ord", F.col("ord.zip_ord").cast("bigint") * 2**31 + F.col("ord.entry_ord"))
    dated = zones.fill_offsets(cut(numbered, "dated"), options.default_zone)
    # a video says its time with an offset, so one that has none is pinned to the default zone
    pinned = zones.pin_wall_clock(F.col("t"), options.default_zone or "UTC")
    pin = F.col("kind").isin(*kinds.VIDEOS) & F.col("t").isNotNull() & F.col("offset_s").isNull()
    step = F.lit("default" if options.default_zone else "utc")
    dated = dated.withColumns({"t": F.when(pin, pinned["instant_s"]).otherwise(F.col("t")), "offset_s": F.when(pin, pinned["offset_s"]).otherwise(F.col("offset_s")), "tz_step": F.when(pin, step).otherwise(F.col("tz_step"))})
    trash = F.lit(False) if options.include_trash else F.col("canon.class") == "trash"
    dated = dated.withColumns({"year": F.year(F.timestamp_seconds(F.col("t") + F.coalesce("offset_s", F.lit(0)))), "skip": trash, "not_importable": kinds.not_importable(F.col("kind"), F.col("canon.name"))})
    fate = ledger.group_fate(F.lit(False), F.col("placeholder"), F.col("skip"), F.col("not_importable"))
    groups = cut(dated.withColumn("fate", fate), "plan")
    half = lambda d, a, b: d.select(F.col(a).alias("id"), F.col(b).alias("pair"), (F.lit(a) == "video").alias("is_video"))
    together = half(paired, "image", "image").unionByName(half(paired, "video", "image")).unionByName(half(raws, "still", "still")).unionByName(half(raws, "raw", "still"))
    where = placing.directory(F.col("placeholder"), F.col("not_importable"), F.col("year"), F.col("kind"))
    right = kinds.output_extension(F.col("kind"), F.col("canon.name"), F.coalesce("is_video", F.lit(False)))
    to_place = groups.where("not skip").join(together, "id", "left").select("id", where.alias("dir"), "ord", "pair", F.concat(text_stem(F.col("canon.name")), right).alias("raw_name"))
    placed = placing.number_names(cut(to_place, "to-place").withColumn("name", names.sanitize(F.col("raw_name"))), taken)
    keys = groups.select(F.col("fate").alias("group_fate"), "group_id")
    own = members.join(keys, "group_id")
    fates = ledger.entry_fates(e, own.select("id", ledger.member_fate(F.col("group_fate"), F.col("class"), options.include_trash).alias("fate")))
    kept = groups.where("not skip")
    fit = ~F.col("placeholder") & ~F.col("not_importable")
    yes = lambda c: F.when(c, "yes")
    rolled = report.rollup(kept, {
        "formats": F.when(fit, F.col("kind")), "years": F.when(fit, F.col("year")), "date_sources": F.when(fit, F.col("source")), "timezone_steps": F.when(fit, F.col("tz_step")),
        "groups": F.col("fate"), "unknown": yes(fit & F.col("t").isNull()), "placeholders": yes(F.col("placeholder")), "motion_photos": yes(fit & (F.col("kind") == "jpeg") & F.col("motion")),
    })
    counts = report.rollup(fates, {"fates": F.col("fate")}).unionByName(report.rollup(paired, {"live_pairs": F.col("how")})).unionByName(report.rollup(raws, {"raw_pairs": F.lit("stem")}))
    near = dedup.names_in_many_groups(members, text.fold_key(F.col("name")), F.col("group_id"))
    off = dedup.conflicts(members.join(groups.select("group_id", F.col("canon.id").alias("_canon")), "group_id").select("group_id", "ord", F.col("sc.taken").alias("t"), F.when(F.col("id") == F.col("_canon"), F.col("ord")).alias("canon")), "group_id", "t", "ord", "canon")
    return Plan(e, matches, groups, paired, placed, fates, rolled.unionByName(counts), raws, near, off)


def text_stem(name: F.Column) -> F.Column:
    """A name without its extension; a name that is all extension stays."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
