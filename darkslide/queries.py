"""Queries over the tables of a data folder, by the operators of the core."""

from __future__ import annotations

import os
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions import dates, folders, kinds, names, text
from darkslide.operators import archives, dating, dedup, journal, ledger, pairs, placing, report, sidecars, spatial, tags, timestamps, zones
from darkslide.oracles import ORACLES
from darkslide.session import shared_dir
from darkslide.sources import archives as archive_source
from darkslide.sources import journal as journal_source
from darkslide.sources.tables import epoch, table

NOW = 1_767_225_600  # 2026-01-01, so that results do not depend on the day of a run
ZONE = "Europe/Berlin"


def sidecar_readings(spark: SparkSession, root: str) -> DataFrame:
    """sidecars with the reading of `taken`; a source is what uploaded the photo."""
    s = table(spark, root, "sidecars").select("sidecar_id", "origin", "taken")
    return timestamps.resolve(s, "taken", "origin")


def tag_readings(spark: SparkSession, root: str) -> DataFrame:
    """embedded_tags joined to their groups, with the reading of `dto`, the rule that decides its zone, and the instants it may name."""
    t = table(spark, root, "embedded_tags").select("tag_id", "group_id", "dto", "offset_time", "device_zone")
    g = table(spark, root, "media_groups").select("group_id", "sidecar_id", F.when(F.col("offset_known"), F.col("offset_s").cast("long")).alias("group_offset_s"))
    t = timestamps.resolve(t, "dto", "device_zone").join(g, "group_id", "left")
    zone = timestamps.known_zone(spark, F.col("device_zone"))
    r = timestamps.camera_readings(F.col("reading.wall_us"), F.col("reading.offset_s"), F.col("offset_time"), zone, F.col("group_offset_s"))
    return t.withColumn("clock", F.when(F.col("reading").isNotNull(), r))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    tags = tag_readings(spark, root).where("reading is not null and sidecar_id is not null").select("tag_id", "sidecar_id", F.col("reading.wall_us").alias("wall_us"), F.col("clock.instants").alias("instants"))
    taken = sidecar_readings(spark, root).where("reading is not null")
    taken = taken.select("sidecar_id", (F.col("reading.wall_us") - F.coalesce(F.col("reading.offset_s"), F.lit(0)) * 1_000_000).alias("taken_us"))
    apart = timestamps.clocks_disagree(F.col("instants"), F.col("wall_us"), F.col("taken_us"))
    return tags.join(taken, "sidecar_id").where(apart).select("tag_id", "sidecar_id").dropDuplicates()


def p4_sidecar_times(spark: SparkSession, root: str) -> DataFrame:
    """One UTC time per sidecar, or none: status is ok, ambiguous or none."""
    r = sidecar_readings(spark, root)
    us = F.col("reading.wall_us") - F.coalesce(F.col("reading.offset_s"), F.lit(0)) * 1_000_000
    status = F.when(F.col("reading").isNull(), "none").when(F.col("reading.ambiguous"), "ambiguous").otherwise("ok")
    return r.select("sidecar_id", status.alias("status"), F.col("reading.fmt").alias("notation"), F.when(status == "ok", us).alias("utc_us"))


def p4_tag_times(spark: SparkSession, root: str) -> DataFrame:
    """One UTC time per tag row, or none: status is ok, ambiguous (two instants, or two notations), gap, open (no zone known) or none."""
    t = tag_readings(spark, root)
    n = F.size("clock.instants")
    status = (
        F.when(F.col("reading").isNull(), "none").when(F.col("reading.ambiguous"), "ambiguous").when(F.col("clock.instants").isNull(), "open")
        .when(n == 0, "gap").when(n > 1, "ambiguous").otherwise("ok")
    )
    return t.select("tag_id", status.alias("status"), F.col("clock.rule").alias("rule"), F.when(status == "ok", F.get("clock.instants", F.lit(0))).alias("utc_us"))


def located_groups(spark: SparkSession, root: str) -> DataFrame:
    """Groups whose sidecar has a location, as points."""
    g = table(spark, root, "media_groups").select("group_id", "sidecar_id", "lat", "lon")
    s = table(spark, root, "sidecars").where("has_geo").select("sidecar_id").dropDuplicates()
    return g.join(s, "sidecar_id", "left_semi").select(F.col("group_id").alias("point_id"), "lat", "lon")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    places = table(spark, root, "places").withColumnRenamed("place_id", "region_id")
    return spatial.points_in_regions(located_groups(spark, root), places).toDF("group_id", "place_id")



def _entries(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entries").withColumn("ord", F.struct("zip_ord", "entry_ord", "entry_id"))


def _groups(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "media_groups").withColumn("t", epoch("instant"))


# -- sources and classification -------------------------------------------------------------------------------------


def archive_missing_parts(spark: SparkSession, root: str) -> DataFrame:
    return archives.missing_in_sequence(table(spark, root, "zips"), "export_id", "part")


def archive_parts(spark: SparkSession, root: str) -> DataFrame:
    z = table(spark, root, "zips").withColumn("p", archives.part_of(F.col("zip_path")))
    return z.select("zip_path", F.col("p.export_id").alias("export_id"), F.col("p.part").cast("bigint").alias("part"))


def line_gaps(spark: SparkSession, root: str) -> DataFrame:
    """Line numbers below an order's last that are missing: the part gaps on another table."""
    return archives.missing_in_sequence(table(spark, root, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")), "l_orderkey", "l_linenumber")


def path_check(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "entries")
    return e.groupBy(folders.safe_path(F.col("entry_name")).alias("safe")).agg(F.count("*").alias("entries"))


def root_split(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "entries").withColumn("s", folders.split_root(F.col("entry_name")))
    return e.select("entry_id", F.col("s.folder").alias("folder"), F.col("s.name").alias("file"))


def fallback_root(spark: SparkSession, root: str) -> DataFrame:
    return archives.fallback_roots(table(spark, root, "entries"))


def system_files(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entries").where(folders.is_system(F.col("entry_name"))).select("entry_id", "name")


def album_json(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entries").where(folders.is_album_json(F.col("name"))).select("entry_id", "rel_folder")


def folder_class(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "entries").groupBy("rel_folder").agg(F.count("*").alias("entries"))
    n = folders.norm_folder(F.col("rel_folder"))
    return f.select("rel_folder", folders.folder_class(n).alias("class"), folders.folder_year(n).cast("bigint").alias("year"), "entries")


def ext_kind(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entries").select("entry_id", kinds.ext_kind(F.col("name")).alias("kind"))


def sniff_kind(spark: SparkSession, root: str) -> DataFrame:
    """Heads made from the known kind of each group, judged again by their bytes."""
    head = {"jpeg": "FFD8FFE000104A464946", "png": "89504E470D0A1A0A0000", "gif": "474946383961", "webp": "524946460000000057454250", "heic": "00000018667479706865696300", "mov": "0000001466747970717420200000", "mp4": "000000186674797069736F6D00", "tiff": "49492A0008000000"}
    g = table(spark, root, "media_groups")
    made = F.coalesce(*(F.when(F.col("kind") == k, F.unhex(F.lit(h))) for k, h in head.items()), F.unhex(F.lit("00FF00FF")))
    return g.select("group_id", kinds.sniff(made).alias("sniffed"))


def screenshots(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entries").where(~F.col("is_json") & kinds.is_screenshot(F.col("name"))).select("entry_id")


# -- names ------------------------------------------------------------------------------------------------------------


def nfc_keys(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.sha2(text.nfc(F.col("text")), 256).alias("nfc_hash"))


def fold_keys(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entries").select("entry_id", text.fold_key(F.col("name")).alias("fold"))


def byte_cut(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entries").select("entry_id", text.fit_bytes(F.col("name"), 46).alias("cut"))


def clean_values(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", text.clean_value(F.col("text")).alias("clean"))


def stems(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entries").select("entry_id", text.live_stem(F.col("name")).alias("stem"), text.strip_number(F.col("name"))["rest"].alias("rest"), text.strip_number(F.col("name"))["number"].alias("number"))


def sanitized(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entries").select("entry_id", names.sanitize(F.col("name")).alias("clean"))


# -- joins ------------------------------------------------------------------------------------------------------------


def sidecar_fields(spark: SparkSession, root: str) -> DataFrame:
    """Sidecars written as JSON and read again by the tolerant parser."""
    s = table(spark, root, "sidecars")
    geo = F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("alt").alias("altitude"))
    made = F.to_json(F.struct("title", "description", "url", F.struct(F.col("taken").alias("timestamp")).alias("photoTakenTime"), F.struct(F.col("creation").alias("timestamp")).alias("creationTime"), geo.alias("geoData")))
    return s.select("sidecar_id", sidecars.parse(made).alias("p")).select("sidecar_id", "p.title", "p.taken", "p.creation", "p.lat", "p.lon", "p.alt")


def sidecar_match(spark: SparkSession, root: str) -> DataFrame:
    """Media matched to the sidecars of their folder by candidate names, in three passes."""
    e = _entries(spark, root).where(~F.col("is_system") & ~F.col("is_symlink"))
    cols = [F.col("entry_id").alias("id"), F.col("rel_folder").alias("folder"), "name", "ord"]
    media = e.where(~F.col("is_json")).select(*cols)
    side = e.where(F.col("is_json") & ~folders.is_album_json(F.col("name"))).select(*cols)
    m = sidecars.match(media, side)
    return m.select(F.col("media_id").alias("entry_id"), "sidecar_id", "pass", "position")


def sidecar_exact(spark: SparkSession, root: str) -> DataFrame:
    """Media whose sidecar has exactly their name with `.json`: the first candidates of the match."""
    e = _entries(spark, root)
    media = e.where(~F.col("is_json") & ~F.col("is_system")).select("entry_id", "rel_folder", F.concat("name", F.lit(".json")).alias("want"))
    side = e.where("is_json").groupBy("rel_folder", F.col("name").alias("want")).agg(F.max_by("entry_id", "ord").alias("sidecar_entry"))
    return media.join(side, ["rel_folder", "want"]).select("entry_id", "sidecar_entry")


def ambiguous_names(spark: SparkSession, root: str) -> DataFrame:
    """Folded sidecar names that more than one sidecar of a folder has, so that none may be matched by them."""
    e = table(spark, root, "entries").where("is_json")
    return e.groupBy("rel_folder", text.fold_key(F.col("name")).alias("fold")).agg(F.count("*").alias("sidecars")).where("sidecars > 1")


def title_check(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "sidecars").withColumn("name", F.element_at(F.split("entry_name", "/"), -1))
    s = s.select("sidecar_id", text.nfc(F.col("title")).alias("t"), text.nfc(F.regexp_replace("name", r"(?i)\.json$", "")).alias("n"))
    return s.where(~sidecars.title_agrees(F.col("t"), F.col("n"))).select("sidecar_id")


def neighbor_offset(spark: SparkSession, root: str) -> DataFrame:
    g = _groups(spark, root)
    asked = g.where("not offset_known").select(F.col("ord").alias("id"), "t")
    donors = g.where("offset_known and tz_step <> 'filename'").select("t", F.col("offset_s").alias("value"), "ord")
    return zones.nearest_donor(asked, donors).select(F.col("id").alias("ord"), "value", "distance")


def neighbor_by_user(spark: SparkSession, root: str) -> DataFrame:
    """The nearest purchase of the same user, within 36 hours, for every other event."""
    e = table(spark, root, "events").select("event_id", "user_id", "event_type", epoch("ts").alias("t"))
    donors = e.where("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("value"), F.col("event_id").alias("ord"))
    out = zones.nearest_donor(e.where("event_type <> 'purchase'").select(F.col("event_id").alias("id"), "user_id", "t"), donors, ["user_id"])
    return out.select(F.col("id").alias("event_id"), "value", "distance")


def live_pairs(spark: SparkSession, root: str) -> DataFrame:
    return pairs.live_pairs(_pairable(spark, root))


def raw_pairs(spark: SparkSession, root: str) -> DataFrame:
    g = _pairable(spark, root)
    taken = pairs.live_pairs(g).select(F.explode(F.array("image", "video")).alias("id"))
    return pairs.raw_pairs(g, taken)


def _pairable(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "media_groups").select(F.col("group_id").alias("id"), "kind", "ord", (F.col("canon_ord") + 1).alias("entry_id"))
    e = table(spark, root, "entries").select("entry_id", F.col("rel_folder").alias("folder"), text.fold_key(text.live_stem(F.col("name"))).alias("stem"))
    c = table(spark, root, "embedded_tags").where("content_identifier is not null").groupBy(F.col("group_id").alias("id")).agg(F.min("content_identifier").alias("content_id"))
    return g.join(e, "entry_id", "left").join(c, "id", "left")


# -- groups -----------------------------------------------------------------------------------------------------------


def dedup_confirmed(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").where("text is not null").withColumn("octets", F.octet_length("text").cast("bigint"))
    out = dedup.confirmed_groups(d, ["n_chars", "octets"], F.sha2("text", 256), "doc_id")
    return out.select("doc_id", "group_ord", F.col("group_rank").cast("bigint").alias("group_rank"), "members")


def dedup_canonical(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "entries").where("not is_json and not is_system")
    return dedup.canonical(e, ["size", "crc32"], "rel_folder", "entry_id")


def near_names(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "entries").where("not is_json and not is_system")
    return dedup.names_in_many_groups(e, text.fold_key(F.col("name")), F.struct("size", "crc32"))


def conflicts(spark: SparkSession, root: str) -> DataFrame:
    """The first order of a customer whose date is more than a year off that of their first order."""
    o = table(spark, root, "orders").select("o_custkey", "o_orderkey", epoch("o_orderdate").alias("t"))
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("canon"))
    out = dedup.conflicts(o.join(first, "o_custkey"), "o_custkey", "t", "o_orderkey", "canon", 365 * 86_400)
    return out.select("o_custkey", F.col("ord").alias("o_orderkey"))


def distinct_times(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").select("user_id", "event_id", epoch("ts").alias("t"))
    return dedup.distinct_times(e, "user_id", "t", "event_id", 3600)


def placeholder_users(spark: SparkSession, root: str) -> DataFrame:
    """Users with at least three events at three distinct hours whose first event has a small value."""
    e = table(spark, root, "events").select("user_id", "event_id", epoch("ts").alias("t"), "value")
    return dedup.placeholders(e, "user_id", "t", "event_id", "value", 3600, 3, 50)


def offset_mode(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "media_groups").where("offset_known").select("kind", "ord", F.col("offset_s").cast("bigint").alias("offset_s"))
    return zones.first_mode(g, "offset_s", "ord", ["kind"])


def event_mode(spark: SparkSession, root: str) -> DataFrame:
    return zones.first_mode(table(spark, root, "events").select("user_id", "event_id", "event_type"), "event_type", "event_id", ["user_id"])


# -- times ------------------------------------------------------------------------------------------------------------


def filename_dates(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "entries").where("not is_json").select("entry_id", dates.from_filename(F.col("name"), F.lit(NOW)).alias("d"))
    return e.where("d is not null").select("entry_id", "d.t", "d.source")


def bounds(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "sidecars").select("sidecar_id", F.col("creation").try_cast("bigint").alias("c"), F.col("taken").try_cast("bigint").alias("k"))
    return s.select("sidecar_id", F.coalesce(dates.in_bounds(F.col("c"), F.lit(NOW)), F.lit(False)).alias("creation_ok"), F.coalesce(dates.taken_in_bounds(F.col("k"), F.lit(NOW)), F.lit(False)).alias("taken_ok"))


def exif_walls(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embedded_tags").select("tag_id", dates.exif_wall(F.col("dto")).alias("wall"))


def implied_offsets(spark: SparkSession, root: str) -> DataFrame:
    """The offset that camera clock and delivered time imply, where it can be one."""
    t = table(spark, root, "embedded_tags").select("tag_id", "group_id", dates.exif_wall(F.col("dto")).alias("wall"))
    g = table(spark, root, "media_groups").select("group_id", "sidecar_id")
    s = table(spark, root, "sidecars").select("sidecar_id", F.col("taken").try_cast("bigint").alias("k")).where("k is not null and k <> 0")
    j = t.join(g, "group_id").join(s, "sidecar_id")
    return j.select("tag_id", dates.delta_offset(F.col("wall"), F.col("k")).alias("offset_s")).where("offset_s is not null")


def dated_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Each sidecar's time by the rule for sidecars, without place or camera."""
    s = table(spark, root, "sidecars").select("sidecar_id", F.col("creation").try_cast("bigint").alias("c"), F.col("taken").try_cast("bigint").alias("k"))
    none = F.lit(None).cast("bigint")
    w = dating.from_sidecar(F.col("k"), F.col("c"), none, none, none, F.lit(NOW))
    return s.select("sidecar_id", w.alias("w")).where("w is not null").select("sidecar_id", "w.t", F.col("w.year").cast("bigint").alias("year"), "w.source")


def local_years(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select("o_orderkey", epoch("o_orderdate").alias("t"))
    off = timestamps.zone_offset_s(F.lit("America/New_York"), F.col("t"))
    return o.select("o_orderkey", off.alias("offset_s"), F.year(F.timestamp_seconds(F.col("t") + off)).cast("bigint").alias("year"))


def pinned_clocks(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").select("event_id", zones.pin_wall_clock(epoch("ts"), ZONE).alias("p"))
    return e.select("event_id", "p.instant_s", "p.offset_s")


def offset_fill(spark: SparkSession, root: str) -> DataFrame:
    g = _groups(spark, root).select(F.col("ord").alias("id"), "ord", "t", F.when(F.col("offset_known"), F.col("offset_s").cast("bigint")).alias("offset_s"), "tz_step", "source")
    return zones.fill_offsets(g).select(F.col("id").alias("ord"), "offset_s", "tz_step")


def date_actions(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "embedded_tags").select("tag_id", "group_id", dates.exif_wall(F.col("dto")).alias("wall"))
    g = _groups(spark, root).where("t is not null").select("group_id", "t")
    return t.join(g, "group_id").select("tag_id", dates.keep_or_write(F.col("wall"), F.col("t")).alias("action"))


# -- placing and tags ---------------------------------------------------------------------------------------------------


def file_numbers(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("dir"), F.concat("p_name", F.lit(".jpg")).alias("name"), F.col("p_partkey").alias("ord"))
    return placing.number_names(p).select(F.col("id").alias("p_partkey"), "name")


def library_names(spark: SparkSession, root: str) -> DataFrame:
    """Names of all groups in their year folders, numbered where they would clash."""
    g = table(spark, root, "media_groups").select("group_id", "ord", "year", (F.col("canon_ord") + 1).alias("entry_id"))
    e = table(spark, root, "entries").select("entry_id", "name")
    d = placing.directory(F.lit(False), F.lit(False), F.col("year"), F.lit(""))
    f = g.join(e, "entry_id").select(F.col("group_id").alias("id"), d.alias("dir"), "name", "ord")
    return placing.number_names(f).select(F.col("id").alias("group_id"), "dir", "name")


def album_numbers(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "entries").select(F.col("rel_folder").alias("folder")).distinct().where(folders.folder_class(F.col("folder")) == "album")
    return placing.number_folders(f.withColumn("name", names.sanitize(F.col("folder"))))


def stride_sample(spark: SparkSession, root: str) -> DataFrame:
    return placing.stride_sample(table(spark, root, "orders").select("o_orderkey"), "o_orderkey", 500)


def album_clones(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "entries").where("not is_json and not is_system").where(folders.folder_class(F.col("rel_folder")) == "album")
    e = e.select(F.concat_ws(":", "size", "crc32").alias("file"), "rel_folder", "entry_id")
    return placing.one_per_album(e, "file", "rel_folder", "entry_id")


def tag_plan(spark: SparkSession, root: str) -> DataFrame:
    g = _groups(spark, root).where("t is not null")
    off = F.when(F.col("offset_known"), F.col("offset_s").cast("bigint"))
    a = tags.arguments(F.col("kind"), F.lit(True), F.lit(False), F.col("t"), off, F.col("lat"), F.col("lon"), F.col("alt"), F.lit(None).cast("string"))
    return g.select("group_id", F.array_join(a, " ").alias("args"))


# -- ledger, report, audit ----------------------------------------------------------------------------------------------


def _fates(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "entries")
    flags = e.select(F.col("entry_id").alias("id"), "is_symlink", "is_system", "is_json", (kinds.is_screenshot(F.col("name")) & ~F.col("is_json")).alias("is_screenshot"))
    none = F.lit(False)
    fate = ledger.member_fate(ledger.group_fate(none, none, none, kinds.not_importable(kinds.ext_kind(F.col("name")), F.col("name"))), folders.folder_class(F.col("rel_folder")))
    grouped = e.where("not is_json and not is_system and not is_symlink").select(F.col("entry_id").alias("id"), fate.alias("fate"))
    return ledger.entry_fates(flags, grouped)


def entry_fates(spark: SparkSession, root: str) -> DataFrame:
    return _fates(spark, root).withColumnRenamed("id", "entry_id")


def ledger_balance(spark: SparkSession, root: str) -> DataFrame:
    return ledger.balance(table(spark, root, "entries"), _fates(spark, root))


def report_rollup(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "media_groups")
    gps = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), "yes")
    return report.rollup(g, {"formats": F.col("kind"), "years": F.col("year"), "date_sources": F.col("source"), "timezone_steps": F.col("tz_step"), "with_gps": gps})


def size_estimate(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "media_groups").select("group_id", (F.col("canon_ord") + 1).alias("entry_id"), "n_members")
    e = table(spark, root, "entries").select("entry_id", "size")
    return report.size_estimate(g.join(e, "entry_id"), "size", (F.col("n_members") - 1).cast("bigint"))


def fat_limit(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "entries").select((F.col("size") * 40).alias("size"), kinds.ext_kind(F.col("name")).alias("kind"))
    return report.too_large(e, "size", "kind")


def first_errors(spark: SparkSession, root: str) -> DataFrame:
    return report.first_errors(table(spark, root, "journal"), "error", "rec_id", 200)


def journal_latest(spark: SparkSession, root: str) -> DataFrame:
    return journal.latest(table(spark, root, "journal").select("rec_id", "id", "stage", "path", "year", "name"), "id", "rec_id")


def pending_groups(spark: SparkSession, root: str) -> DataFrame:
    last = journal.latest(table(spark, root, "journal").select("rec_id", "id", "stage"), "id", "rec_id").withColumnRenamed("id", "group_id")
    return journal.pending(table(spark, root, "media_groups").select("group_id"), last, "group_id")


def missing_files(spark: SparkSession, root: str) -> DataFrame:
    """Placed paths whose file name no entry has: an audit against a listing."""
    last = journal.latest(table(spark, root, "journal").select("rec_id", "id", "stage", "path", "albums"), "id", "rec_id")
    listing = table(spark, root, "journal").where("stage = 'placing'").select("path").where("path is not null")
    return journal.missing_files(last, listing)


def year_mismatch(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "embedded_tags").select("tag_id", "group_id", "dto", "creation_date")
    g = table(spark, root, "media_groups").select("group_id", F.col("year").cast("string").alias("folder"), "kind")
    out = journal.year_mismatches(t.join(g, "group_id").withColumnRenamed("tag_id", "id"))
    return out.select(F.col("id").alias("tag_id"), "folder", F.col("tag_year").cast("bigint").alias("tag_year"))


# -- sources read back ------------------------------------------------------------------------------------------------


def _archives(spark: SparkSession, root: str) -> str:
    """A folder of zip archives with every distinct entry of the index; the body of an entry is its name. Written once for each data folder."""
    folder = f"{shared_dir(spark).removeprefix('file://')}/archives-{uuid.uuid4().hex}"
    spark.dataSource.register(archive_source.ArchiveSource)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        base = pdf["zip_path"].iloc[0].rsplit("/", 1)[-1]
        with zipfile.ZipFile(f"{folder}/{base}", "w") as z:
            for n in sorted(pdf["entry_name"]):
                z.writestr(zipfile.ZipInfo(n), n.encode())
        return pd.DataFrame({"files": [len(pdf)]})

    # one archive is one task, as an archive is one file
    table(spark, root, "entries").select("zip_path", "entry_name").distinct().groupBy("zip_path").applyInPandas(write, "files long").count()
    return folder


def archive_index(spark: SparkSession, root: str) -> DataFrame:
    """The directory of archives written from the index, as the archives source reads it."""
    z = spark.read.format("archives").option("path", _archives(spark, root)).load()
    return z.select(F.element_at(F.split("zip_path", "/"), -1).alias("zip"), "entry_name", "size", "is_symlink")


def archive_bodies(spark: SparkSession, root: str) -> DataFrame:
    """The hash and size of the body of every sidecar in those archives."""
    z = spark.read.format("archives").option("path", _archives(spark, root)).option("mode", "content").option("suffix", ".json").load()
    return z.select(F.element_at(F.split("zip_path", "/"), -1).alias("zip"), "entry_name", "sha256", F.octet_length("content").cast("bigint").alias("octets"), "error")


def journal_lines(spark: SparkSession, root: str) -> DataFrame:
    """The journal written as JSON lines, one of them torn, and read back by its source."""
    path = f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    cols = ("id", "sha", "stage", "path", "year", "name", "error", "albums")
    lines = table(spark, root, "journal").select(F.to_json(F.struct(*cols)).alias("value"))
    torn = spark.range(1).select(F.lit('{"id": "torn').alias("value"))
    lines.unionByName(torn).write.text(path)
    r = journal_source.read(spark, path)
    return r.select("id", "sha", "stage", "path", "year", "name", "error", F.coalesce(F.size("albums"), F.lit(-1)).cast("bigint").alias("albums"))


# -- smaller steps of the plan ----------------------------------------------------------------------------------------


def fallback_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries read below the one top folder that holds media and sidecars, as if its name were not listed."""
    e = archives.under_fallback_root(table(spark, root, "entries").select("entry_id", "entry_name", "is_json"))
    return e.select("entry_id", "folder", F.col("name").alias("file"))


def picked_values(spark: SparkSession, root: str) -> DataFrame:
    """For each user the purchase of the last event, else the first purchase: how a group picks its sidecar."""
    e = table(spark, root, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("bought"))
    last = e.groupBy("user_id").agg(F.max("event_id").alias("canon"))
    return sidecars.pick_for_groups(e.join(last, "user_id"), "user_id", "bought", "event_id", "canon").withColumnRenamed("sidecar", "event_id")


def fate_union(spark: SparkSession, root: str) -> DataFrame:
    """The least return flag of an order's lines where it has any, overruled by the status of orders that are not open."""
    flags = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("mark"))
    status = table(spark, root, "orders").where("o_orderstatus <> 'O'").select("o_orderkey", F.col("o_orderstatus").alias("mark"))
    return ledger.by_priority([flags, status], "o_orderkey", "mark")


def shared_times(spark: SparkSession, root: str) -> DataFrame:
    """Times of groups after the halves of live photos have handed theirs over."""
    g = _pairable(spark, root)
    t = _groups(spark, root).select(F.col("group_id").alias("id"), "t", "source")
    return pairs.propagate(t, pairs.live_pairs(g)).select(F.col("id").alias("group_id"), "t", "source")


def output_names(spark: SparkSession, root: str) -> DataFrame:
    """The extension that each group's kind asks for in place of its name's."""
    g = table(spark, root, "media_groups").select("group_id", "kind", (F.col("canon_ord") + 1).alias("entry_id"))
    e = table(spark, root, "entries").select("entry_id", "name")
    return g.join(e, "entry_id").select("group_id", kinds.output_extension(F.col("kind"), F.col("name"), F.lit(False)).alias("ext"))


def directories(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "media_groups").withColumn("copy", F.coalesce("placeholder", F.lit(False)))
    return g.groupBy(placing.directory(F.col("copy"), F.lit(False), F.col("year"), F.col("kind")).alias("dir")).agg(F.count("*").alias("files"))


def tag_places(spark: SparkSession, root: str) -> DataFrame:
    """The arguments that write a group's place and caption."""
    g = _groups(spark, root).where("lat between -90 and 90 and lon between -180 and 180")
    a = tags.arguments(F.col("kind"), F.lit(False), F.lit(True), F.col("t"), F.lit(None).cast("bigint"), F.floor(F.col("lat") * 1000) / 1000, F.floor(F.col("lon") * 1000) / 1000, F.floor(F.col("alt") * 10) / 10, F.col("description"))
    return g.select("group_id", F.array_join(a, " ").alias("args"))


def last_purchases(spark: SparkSession, root: str) -> DataFrame:
    """The last purchase of a user up to each event."""
    e = table(spark, root, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("bought"))
    return zones.running_known(e, ["user_id"], "event_id", "bought").select("event_id", "last_known")


QUERIES = (
    p4_found, p4_sidecar_times, p4_tag_times, p5_found,
    archive_missing_parts, archive_parts, line_gaps, path_check, root_split, fallback_root, system_files, album_json, folder_class, ext_kind, sniff_kind, screenshots,
    nfc_keys, fold_keys, byte_cut, clean_values, stems, sanitized,
    sidecar_fields, sidecar_match, sidecar_exact, ambiguous_names, title_check, neighbor_offset, neighbor_by_user, live_pairs, raw_pairs,
    dedup_confirmed, dedup_canonical, near_names, conflicts, distinct_times, placeholder_users, offset_mode, event_mode,
    filename_dates, bounds, exif_walls, implied_offsets, dated_sidecars, local_years, pinned_clocks, offset_fill, date_actions,
    file_numbers, library_names, album_numbers, stride_sample, album_clones, tag_plan,
    entry_fates, ledger_balance, report_rollup, size_estimate, fat_limit, first_errors, journal_latest, pending_groups, missing_files, year_mismatch,
    archive_index, archive_bodies, journal_lines, fallback_entries, picked_values, fate_union, shared_times, output_names, directories, tag_places, last_purchases,
)


def queries() -> dict:
    """Every query of the core by name."""
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL with the same rows, where SQL can say it."""
    return dict(ORACLES)
