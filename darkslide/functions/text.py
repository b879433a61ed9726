"""Unicode keys and byte-exact cutting of names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkslide.functions.lets import let


def _plain(s: pd.Series) -> list[str | None]:
    return [v if isinstance(v, str) else None for v in s]


@F.pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else unicodedata.normalize("NFC", v) for v in _plain(s)], dtype=object)


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def nfc(c: Column) -> Column:
    """Composed form (NFC). ASCII values, nearly all of them, never leave the JVM."""
    return F.when(is_ascii(c), c).otherwise(_nfc_udf(F.when(~is_ascii(c), c)))


@F.pandas_udf(T.StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else "".join(c.lower()[:1] for c in unicodedata.normalize("NFC", v)) for v in _plain(s)], dtype=object)


def fold_key(c: Column) -> Column:
    """Composed and lower-cased code point by code point, so that no context rule changes a letter."""
    return F.when(is_ascii(c), F.lower(c)).otherwise(_fold_udf(F.when(~is_ascii(c), c)))


def fit_bytes(c: Column, limit: int | Column) -> Column:
    """The longest prefix of whole code points within limit bytes of UTF-8; '' where the limit is not positive."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    raw = lambda k: F.substring(F.encode(c, "UTF-8"), F.lit(1), F.greatest(n - k, F.lit(0)))
    # a code point has at most four bytes, so one of four cuts is whole
    tries = F.coalesce(*(F.when(F.is_valid_utf8(raw(k).cast("string")), raw(k).cast("string")) for k in range(4)))
    return F.when(F.octet_length(c) <= n, c).otherwise(tries)


def extension(c: Column) -> Column:
    """From the last dot of a base name on: '' without a dot; a name that begins with its only dot is all extension."""
    return F.regexp_extract(c, r"(\.[^.]*)$", 1)


def fit_name(c: Column, limit: int = 255) -> Column:
    """A file name cut to limit bytes, its extension kept."""
    ext = extension(c)
    stem = F.substring(c, F.lit(1), F.length(c) - F.length(ext))
    # an extension longer than the limit leaves no stem; names within the limit stay
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.concat(fit_bytes(stem, F.lit(limit) - F.octet_length(ext)), ext))


def clean_value(c: Column) -> Column:
    """Runs of control characters with the spaces around them become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, r" *[\x00-\x1f\x7f][\x00-\x1f\x7f ]*", " "))


# Endings that editors put on names of edited copies.
EDITED = ("-edited", "-edit", "-effects", "-bearbeitet", "-modifie", "-modifié", "-ha editado", "-edytowano", "-bewerkt", "-編集済み")


def strip_number(c: Column) -> Column:
    """(rest, number): the first `(N)` taken out; number is '' where there is none."""
    number = F.regexp_extract(c, r"\((\d+)\)", 1)
    rest = let(F.regexp_extract(c, r"^(.*?)\(\d+\)", 1), lambda head: F.concat(head, F.substring(c, F.length(head) + F.length(number) + 3, F.lit(1_000_000))))
    return F.struct(F.when(number == "", c).otherwise(rest).alias("rest"), number.alias("number"))


def strip_edited(c: Column) -> Column:
    """A stem without its editor's ending, any case; unchanged where it has none."""
    low = F.lower(c)
    out = c
    for e in reversed(EDITED):
        out = F.when(F.endswith(low, F.lit(e)) & (F.length(c) > len(e)), F.substring(c, F.lit(1), F.length(c) - len(e))).otherwise(out)
    return out


def live_stem(c: Column) -> Column:
    """A name without its extension and without `.MP` or `.MV` before it."""
    return F.regexp_replace(F.regexp_replace(c, r"\.[^.]*$", ""), r"(?i)\.m[pv]$", "")
