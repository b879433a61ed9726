"""The capture time of a group from its sidecar, its camera tags and its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from darkslide.functions import dates
from darkslide.functions.lets import let

WHEN = "struct<t:bigint,offset_s:bigint,year:int,source:string,tz_step:string>"


def _year(t: Column, offset: Column) -> Column:
    return F.year(F.timestamp_seconds(t + F.coalesce(offset, F.lit(0))))


def _when(t: Column, offset: Column, source: Column | str, step: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(t.cast("bigint").alias("t"), offset.cast("bigint").alias("offset_s"), _year(t, offset).alias("year"), lit(source).alias("source"), lit(step).alias("tz_step"))


def from_sidecar(taken: Column, creation: Column, zone_offset: Column, tag_offset: Column, wall: Column, now: Column) -> Column:
    """The delivered capture time, else the upload time; its offset from the place's zone, else the camera's offset, else what the camera's clock implies."""
    t = F.when(dates.taken_in_bounds(taken, now), taken).when(dates.in_bounds(creation, now), creation)
    source = F.when(dates.taken_in_bounds(taken, now), "json-taken").otherwise("json-creation")

    def make(t: Column) -> Column:
        implied = dates.delta_offset(wall, t)
        offset = F.coalesce(zone_offset, tag_offset, implied)
        step = F.when(zone_offset.isNotNull(), "gps").when(tag_offset.isNotNull(), "embedded-offset").when(implied.isNotNull(), "dto-minus-utc")
        return F.when(t.isNotNull(), _when(t, offset, source, step))

    return let(t, make)


def from_tags(wall: Column, tag_offset: Column, now: Column) -> Column:
    """The camera's time: an instant with an offset, else a wall clock."""
    step = F.when(tag_offset.isNotNull(), "embedded-offset").otherwise("filename")
    t = wall - F.coalesce(tag_offset, F.lit(0))
    return F.when(dates.in_bounds(wall, now), _when(t, tag_offset, "embedded", step))


def from_name(name: Column, now: Column) -> Column:
    return let(dates.from_filename(name, now), lambda d: F.when(d.isNotNull(), _when(d["t"], F.lit(None), d["source"], F.lit("filename"))))


def resolve(sidecar: Column, tags: Column, name: Column) -> Column:
    """The first that gives a time, whole: fields of a later one do not fill an earlier one."""
    return F.coalesce(sidecar, tags, name)


def weak(when: Column) -> Column:
    """No time, or one from a name only."""
    return when.isNull() | when["source"].isin("filename", "filename-date")
