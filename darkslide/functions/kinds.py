"""Kinds of files, by their first bytes and by their names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from darkslide.functions.text import extension

# Extensions by kind, documents, and kinds by what can be done with them.
EXTENSIONS = {
    "raw": ("dng", "cr2", "nef", "nrw", "arw", "srw", "pef", "orf", "rw2", "raf"), "cr3": ("cr3",), "avi": ("avi",), "mpg": ("mpg", "mpeg", "vob"), "wmv": ("wmv", "asf"),
    "mts": ("mts", "m2ts"), "bmp": ("bmp",), "tiff": ("tif", "tiff"), "jpeg": ("jpg", "jpeg"), "png": ("png",), "gif": ("gif",), "webp": ("webp",), "heic": ("heic",), "mov": ("mov",),
    "mp4": ("mp4", "m4v", "3gp", "3g2", "mp", "mv"), "webm": ("webm", "mkv"),
}
DOCUMENTS = ("txt", "pdf", "html", "htm", "md", "rtf", "doc", "docx", "odt", "pages", "xls", "xlsx", "csv", "numbers", "ppt", "pptx", "key", "zip", "rar", "7z", "eml", "log", "xml", "ini", "db")
IMAGES = ("jpeg", "heic", "png", "gif", "webp", "tiff", "bmp", "raw", "cr3")
VIDEOS = ("mp4", "mov")
TAGGABLE = ("jpeg", "heic", "png", "gif", "webp", "tiff", "mp4", "mov")
HEIC_BRANDS = ("heic", "heix", "hevc", "hevx", "mif1", "msf1", "heim", "heis")
EXTENSION_OF = {"jpeg": ".jpg", "png": ".png", "gif": ".gif", "webp": ".webp", "heic": ".heic", "mov": ".mov", "mp4": ".mp4", "webm": ".webm", "tiff": ".tif", "bmp": ".bmp", "avi": ".avi", "mpg": ".mpg", "wmv": ".wmv", "cr3": ".cr3", "mts": ".mts"}


def sniff(head: Column) -> Column:
    """The kind that the first bytes tell; unknown if none does. The first rule that fits wins."""
    hexed = F.hex(head)
    at = lambda i, n: F.substring(hexed, 2 * i + 1, 2 * n)
    text = lambda s: F.lit(s.encode().hex().upper())
    brand = at(8, 4)
    return (
        F.when(at(0, 3) == "FFD8FF", "jpeg")
        .when(at(0, 8) == "89504E470D0A1A0A", "png")
        .when(at(0, 6).isin(b"GIF87a".hex().upper(), b"GIF89a".hex().upper()), "gif")
        .when((at(0, 4) == text("RIFF")) & (at(8, 4) == text("WEBP")), "webp")
        .when((at(0, 4) == text("RIFF")) & (at(8, 4) == text("AVI ")), "avi")
        .when(at(0, 4) == "000001BA", "mpg")
        .when(at(0, 4) == "3026B275", "wmv")
        .when((at(0, 2) == text("BM")) & (at(6, 4) == "00000000") & (F.length(hexed) >= 28), "bmp")
        .when(at(0, 4) == "1A45DFA3", "webm")
        .when(at(0, 4).isin("49492A00", "4D4D002A"), "tiff")
        .when(at(0, 4).isin(*(x.hex().upper() for x in (b"IIRO", b"IIRS", b"MMOR", b"IIU\0"))) | (at(0, 15) == text("FUJIFILMCCD-RAW")), "raw")
        .when((at(4, 4) == text("ftyp")) & (brand == text("crx ")), "cr3")
        .when((at(4, 4) == text("ftyp")) & brand.isin(*(b.encode().hex().upper() for b in HEIC_BRANDS)), "heic")
        .when((at(4, 4) == text("ftyp")) & (brand == text("qt  ")), "mov")
        .when(at(4, 4) == text("ftyp"), "mp4")
        .otherwise("unknown")
    )


def ext_kind(name: Column) -> Column:
    """The kind that a name's extension tells; `.mp~2` and the like count as mp4."""
    ext = F.substring(F.lower(extension(name)), 2, 100)
    known = reduce(lambda w, k: w.when(ext.isin(*EXTENSIONS[k]), k), EXTENSIONS, F.when(F.lit(False), ""))
    return known.when(F.startswith(ext, F.lit("mp~")), "mp4").otherwise("unknown")


def kind(head: Column, name: Column) -> Column:
    """By bytes, but a TIFF with the extension of a raw format is raw."""
    s = sniff(head)
    return F.when((s == "tiff") & (ext_kind(name) == "raw"), "raw").otherwise(s)


def is_motion_photo(kind_: Column, name: Column, head: Column) -> Column:
    """A JPEG that carries a video: by its name, or by the marker in its first 256 KiB."""
    return (kind_ == "jpeg") & (F.endswith(F.lower(name), F.lit(".mp")) | F.contains(F.hex(F.substring(head, 1, 262144)), F.lit(b"MotionPhoto".hex().upper())))


def not_importable(kind_: Column, name: Column) -> Column:
    """Documents that lie among the photos."""
    return (kind_ == "unknown") & F.substring(F.lower(extension(name)), 2, 100).isin(*DOCUMENTS)


def is_screenshot(name: Column) -> Column:
    return F.rlike(F.lower(name), F.lit("^screen ?shot"))


def output_extension(kind_: Column, name: Column, live_video: Column) -> Column:
    """The extension that the true kind asks for; raw and unknown files keep theirs, the video of a live photo is .MOV."""
    own = extension(name)
    fixed = reduce(lambda w, k: w.when(kind_ == k, EXTENSION_OF[k]), EXTENSION_OF, F.when(F.lit(False), ""))
    right = ext_kind(name) == kind_
    return F.when(live_video, ".MOV").when(right | kind_.isin("raw", "unknown"), own).otherwise(fixed)
