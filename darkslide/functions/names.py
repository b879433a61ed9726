"""File names that every system takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from darkslide.functions.text import extension, fit_name, nfc

# Device names that Windows keeps for itself.
_RESERVED = "^(?i)(con|prn|aux|nul|conin\\$|conout\\$|com[1-9¹²³]|lpt[1-9¹²³]) *(\\.|$)"


def avoid_reserved(name: Column) -> Column:
    """A reserved device name before the first dot gets an underscore after it."""
    head = F.regexp_extract(name, r"^([^.]*)", 1)
    return F.when(F.rlike(name, F.lit(_RESERVED)), F.concat(F.rtrim(head), F.lit("_"), F.substring(name, F.length(head) + 1, F.lit(1_000_000)))).otherwise(name)


def sanitize(name: Column, rule: str = "portable", limit: int = 255) -> Column:
    """A name safe as one path segment: composed; separators and controls as `-`; by the portable rule also what Windows forbids; no dot or space at the end; never empty; within limit bytes."""
    banned = r"[\x00-\x1f\x7f:/\\" + ('<>"|?*' if rule == "portable" else "") + "]"
    clean = F.regexp_replace(F.regexp_replace(nfc(name), banned, "-"), "[. ]+$", "")
    clean = F.when(clean == "", "file").otherwise(clean)
    return fit_name(avoid_reserved(clean) if rule == "portable" else clean, limit)


def sanitize_path(path: Column, rule: str = "portable") -> Column:
    """Each segment of a path made plain without Unicode composition, for composed paths; empty, `.` and `..` segments are dropped."""
    banned = r"[\x00-\x1f\x7f:\\" + ('<>"|?*' if rule == "portable" else "") + "]"
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, banned, "-"), "[. ]+$", "")), "/")


def with_index(name: Column, n: Column, limit: int = 255) -> Column:
    """`name (n).ext` for n of 2 and more, within limit bytes; the name itself for n of 1."""
    ext = extension(name)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(n < 2, name).otherwise(fit_name(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext), limit))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")
