"""What a tag writer is to be told about a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from darkslide.functions.dates import format_offset
from darkslide.functions.kinds import TAGGABLE, VIDEOS
from darkslide.functions.text import clean_value


def arguments(kind: Column, write_dates: Column, write_gps: Column, t: Column, offset: Column, lat: Column, lon: Column, alt: Column, description: Column) -> Column:
    """The arguments for one file, in order. t is the instant (the wall clock where offset is null).

    A GIF takes its date as XMP; a video its local date with offset and six QuickTime dates in UTC; a still three
    EXIF dates and, where the offset is known, three offsets, a PNG also XMP dates. Places go with references for
    stills and as one value for videos; descriptions into two tags, but for a GIF.
    """
    local = F.date_format(F.timestamp_seconds(t + F.coalesce(offset, F.lit(0))), "yyyy:MM:dd HH:mm:ss")
    utc = F.date_format(F.timestamp_seconds(t), "yyyy:MM:dd HH:mm:ss")
    zone = F.when(offset.isNotNull(), format_offset(offset)).otherwise("")
    video, gif = kind.isin(*VIDEOS), kind == "gif"
    say = lambda name, value: F.concat(F.lit(f"-{name}="), value)
    each = lambda names, value: [say(n, value) for n in names]
    if_ = lambda test, args: [F.when(test, a) for a in args]
    caption = clean_value(description)
    six = "%.6f"
    args = [
        *if_(write_dates & gif, each(("XMP-exif:DateTimeOriginal",), F.concat(local, zone))),
        *if_(write_dates & video, each(("Keys:CreationDate",), F.concat(local, zone))),
        *if_(write_dates & video, each(("QuickTime:CreateDate", "QuickTime:ModifyDate", "QuickTime:TrackCreateDate", "QuickTime:TrackModifyDate", "QuickTime:MediaCreateDate", "QuickTime:MediaModifyDate"), utc)),
        *if_(write_dates & ~video & ~gif, each(("EXIF:DateTimeOriginal", "EXIF:CreateDate", "EXIF:ModifyDate"), local)),
        *if_(write_dates & ~video & ~gif & offset.isNotNull(), each(("EXIF:OffsetTimeOriginal", "EXIF:OffsetTimeDigitized", "EXIF:OffsetTime"), zone)),
        *if_(write_dates & (kind == "png"), each(("XMP-exif:DateTimeOriginal", "XMP-xmp:CreateDate"), F.concat(local, zone))),
        *if_(write_gps & video, [say("Keys:GPSCoordinates", F.concat_ws(", ", F.format_string(six, lat), F.format_string(six, lon), F.when(alt.isNotNull(), F.format_string("%.3f", alt))))]),
        *if_(write_gps & ~video, [say("GPSLatitude", F.format_string(six, F.abs(lat))), say("GPSLatitudeRef", F.when(lat < 0, "S").otherwise("N")), say("GPSLongitude", F.format_string(six, F.abs(lon))), say("GPSLongitudeRef", F.when(lon < 0, "W").otherwise("E"))]),
        *if_(write_gps & ~video & alt.isNotNull(), [say("GPSAltitude", F.format_string("%.3f", F.abs(alt))), say("GPSAltitudeRef", F.when(alt < 0, "1").otherwise("0"))]),
        *if_(~gif & (caption != ""), each(("Description", "ImageDescription"), caption)),
    ]
    return F.array_compact(F.array(*args))


def action(kind: Column, placeholder: Column, skip: Column, readable: Column, args: Column) -> Column:
    """write, nothing (there is nothing to say), skip (not a file for tags) or error (its own tags cannot be read)."""
    return F.when(skip | placeholder | ~kind.isin(*TAGGABLE), "skip").when(~readable, "error").when(F.size(args) == 0, "nothing").otherwise("write")
