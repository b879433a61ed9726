"""Capture times from names, sidecars and camera tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from darkslide.functions.lets import let

# Shapes of dates in names, with the digits of year to second in one row.
_Y, _M = "((?:18|19|20)\\d{2})", "(0[1-9]|1[0-2])"
_D, _H, _N = "([0-3]\\d)", "([0-2]\\d)", "([0-5]\\d)"
_SHAPES = (
    f"{_Y}{_M}{_D}-{_H}{_N}{_N}",
    f"{_Y}{_M}{_D}_{_H}{_N}{_N}",
    f"{_Y}-{_M}-{_D}-{_H}-{_N}-{_N}",
    f"{_Y}-{_M}-{_D}-{_H}{_N}{_N}",
    f"{_Y}{_M}{_D}{_H}{_N}{_N}",
    f"{_Y}_{_M}_{_D}_{_H}_{_N}_{_N}",
)
_MILLIS = r"(?:^|\D)(\d{13})(?:\D|$)"
_DAYS = (rf"^(?:IMG|VID|AUD|PTT|STK)-{_Y}{_M}(\d{{2}})-WA\d+", rf"^{_Y}-{_M}-(\d{{2}})[_ ]", rf"^{_Y}{_M}(\d{{2}})_\D")
LOW, LOW_TAKEN, DAY = 631_152_000, -5_364_662_400, 86_400  # 1990-01-01, 1800-01-01


def in_bounds(t: Column, now: Column) -> Column:
    """Whether seconds lie from 1990 to a day after now."""
    return t.between(F.lit(LOW), now + DAY)


def taken_in_bounds(t: Column, now: Column) -> Column:
    """Whether a delivered capture time is one: from 1800 to a day after now, and not the epoch itself."""
    return t.between(F.lit(LOW_TAKEN), now + DAY) & (t != 0)


def _seconds(g: list[Column]) -> Column:
    n = [x.try_cast("int") for x in g]
    stamp = F.try_make_timestamp_ntz(n[0], n[1], n[2], n[3], n[4], F.when(n[5] < 60, n[5]).cast("decimal(16,6)"))
    return F.unix_timestamp(stamp.cast("timestamp"))


def from_filename(name: Column, now: Column) -> Column:
    """(t, source) of the date in a name: wall-clock seconds as if UTC, source `filename` or `filename-date` (noon). A shape that gives no date within bounds leaves the word to the next; names that begin with `-` have none."""
    tries = []
    for p in _SHAPES:
        parts = [F.regexp_extract(name, p, i) for i in range(1, 7)]
        tries.append(let(_seconds(parts), lambda t: F.when(in_bounds(t, now), F.struct(t.alias("t"), F.lit("filename").alias("source")))))
    ms = F.floor(F.regexp_extract(name, _MILLIS, 1).try_cast("long") / 1000).cast("long")
    tries.append(let(ms, lambda t: F.when(in_bounds(t, now), F.struct(t.alias("t"), F.lit("filename").alias("source")))))
    for p in _DAYS:
        parts = [F.regexp_extract(name, p, i) for i in range(1, 4)] + [F.lit("12"), F.lit("0"), F.lit("0")]
        tries.append(let(_seconds(parts), lambda t: F.when(in_bounds(t, now), F.struct(t.alias("t"), F.lit("filename-date").alias("source")))))
    return F.when(~F.startswith(name, F.lit("-")), F.coalesce(*tries))


def exif_wall(text: Column) -> Column:
    """Wall-clock seconds of `yyyy:MM:dd HH:mm:ss` at the start of a text, else null; hour 24 and 30 February are no times."""
    p = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}):(\d{2}):(\d{2})"
    return _seconds([F.regexp_extract(text, p, i) for i in range(1, 7)])


def valid_offset(seconds: Column) -> Column:
    """Whether a number of seconds can be a zone offset: at most 14 hours either way, in whole quarter hours."""
    return (F.abs(seconds) <= 14 * 3600) & (seconds % 900 == 0)


def delta_offset(wall: Column, instant: Column) -> Column:
    """The offset that a wall clock and an instant of one moment imply, rounded to the minute, if it is valid."""
    d = F.round((wall - instant) / 60).cast("long") * 60
    return F.when(valid_offset(d), d)


def format_offset(seconds: Column) -> Column:
    a = F.abs(seconds)
    return F.format_string("%s%02d:%02d", F.when(seconds < 0, "-").otherwise("+"), F.floor(a / 3600).cast("int"), F.floor(a % 3600 / 60).cast("int"))


def keep_or_write(own: Column, wanted: Column) -> Column:
    """write where there is no time yet, or one more than a minute off; else keep."""
    return F.when(own.isNull() | (F.abs(own - wanted) > 60), "write").otherwise("keep")
