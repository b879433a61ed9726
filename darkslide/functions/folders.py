"""Where an archive entry lies and what kind of folder that is."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The localized names of the root folder, of year folders, of the trash and of other library folders.
ROOTS = (
    "Google Photos", "Google Fotos", "Google Foto's", "Google Foto_s", "Google Foto", "Photos Google", "Zdjęcia Google", "Google Фото", "Fotky Google", "Google Foton",
    "Google Bilder", "Google Billeder", "Google Kuvat", "Google Fotók", "Google Fotoğraflar", "Google フォト", "Google 포토", "Google 相片", "Google 照片",
)
YEAR_PREFIXES = (
    "Photos from ", "Fotos von ", "Fotos aus ", "Photos de ", "Fotos de ", "Foto's uit ", "Foto_s van ", "Foto dal ", "Foto del ", "Zdjęcia z ", "Фото за ", "Фотографии за ",
    "Fotky z ", "Fotografii din ", "Foton från ", "Bilder fra ", "Billeder fra ", "Valokuvat ", "Fényképek - ", "Fotoğraflar ",
)
YEAR_SUFFIXES = (" 年の写真", "年のフォト", "년의 사진", "年的照片", "年的相片")
TRASH = (
    "trash", "bin", "papierkorb", "corbeille", "papelera", "cestino", "lixeira", "lixo", "prullenbak", "kosz", "корзина", "кошик", "koš", "papperskorg", "papirkurv", "roskakori",
    "çöp kutusu", "kuka", "ゴミ箱", "휴지통", "垃圾桶", "回收站", "垃圾箱",
)
LIBRARY = ("archive", "locked folder", "failed videos", "archiv", "archives", "archivo", "archivio", "arquivo", "archief", "archiwum", "архив", "архів", "アーカイブ", "보관함")
ALBUM_JSON = ("metadata.json", "shared_album_comments.json", "user-generated-memory-titles.json")

_SPACE = r"[\p{Z}\s\x{85}]"
# Fixed value: a year before or after words, as year folders of unlisted languages have it.
_ANY_YEAR = r"^(?:\p{L}[\p{L}' ]*[ _-])?((?:18|19|20)\d{2})(?:[ _-][\p{L}' ]*\p{L})?$"
_YEAR = "^(?:(?:" + "|".join(YEAR_PREFIXES) + r")(\d{4})|(\d{4})(?:" + "|".join(YEAR_SUFFIXES) + "))$"


def safe_path(entry: Column) -> Column:
    """False for absolute paths, backslashes and `..` segments; such an archive must not be read on."""
    return ~(F.startswith(entry, F.lit("/")) | F.contains(entry, F.lit("\\")) | F.array_contains(F.split(entry, "/"), ".."))


def split_root(entry: Column) -> Column:
    """(folder, name) below the first segment that is a root name, else null. Deeper folders are flattened: the name is the last segment, the folder the one after the root."""
    parts = F.split(entry, "/")
    # archives packed again on other systems write names decomposed
    spelled = dict.fromkeys(unicodedata.normalize(form, r) for r in ROOTS for form in ("NFC", "NFD"))
    at = F.array_min(F.array_compact(F.transform(F.array(*map(F.lit, spelled)), lambda r: F.nullif(F.array_position(parts, r), F.lit(0)))))
    n = F.size(parts)
    name = F.element_at(parts, -1)
    folder = F.when(n - at >= 2, F.get(parts, at.cast("int"))).otherwise("")
    return F.when(at.isNotNull() & (n > at) & (name != ""), F.struct(folder.alias("folder"), name.alias("name")))


def is_system(entry: Column) -> Column:
    """Files of operating systems: below __MACOSX, `._` names, and folder databases."""
    base = F.element_at(F.split(entry, "/"), -1)
    return F.array_contains(F.split(entry, "/"), "__MACOSX") | F.startswith(base, F.lit("._")) | F.lower(base).isin(".ds_store", "thumbs.db", "desktop.ini")


def is_album_json(name: Column) -> Column:
    """JSON files that describe an album, not a photo."""
    return F.lower(name).isin(*ALBUM_JSON)


def norm_folder(folder: Column) -> Column:
    """Odd spaces as plain ones, white space of any kind trimmed; the folder is expected composed."""
    plain = F.translate(folder, "\u00a0\u202f\u2007", "   ")
    return F.regexp_replace(plain, f"^{_SPACE}+|{_SPACE}+$", "")


def generic_year(folder: Column) -> Column:
    """The year of a folder that is one word and a year in any language, 1800 to 2100, else null; for exports whose root has an unknown name."""
    y = F.regexp_extract(folder, _ANY_YEAR, 1).try_cast("int")
    return F.when(y.between(1800, 2100), y)


def folder_year(folder: Column) -> Column:
    """The year of a year folder, 1800 to 2100, else null."""
    y = F.concat(F.regexp_extract(folder, _YEAR, 1), F.regexp_extract(folder, _YEAR, 2)).try_cast("int")
    return F.when(y.between(1800, 2100), y)


def folder_class(folder: Column) -> Column:
    """library, trash or album; a folder without name belongs to the library."""
    low = F.lower(folder)
    return F.when(folder == "", "library").when(low.isin(*TRASH), "trash").when(low.isin(*LIBRARY), "library").when(folder_year(folder).isNotNull(), "library").otherwise("album")
