"""Text that was decoded with the wrong character encoding: detection and repair.

The characters of a value are mapped back to the bytes they had in a legacy encoding. A byte-structure
automaton finds the maximal spans of well-formed multibyte UTF-8 in those bytes, and only those spans are
decoded again; the rest of the value stays as it is. Values garbled twice take another round. Bytes of one
legacy encoding read in another have no such structure; they are found word by word, through a repair that
turns a rare word into a common one (see word_repairs).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SINGLE = ("western", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp866", "koi8_r")
DOUBLE = ("cp932", "gbk")
CYRILLIC = ("cp1251", "cp866", "koi8_r")
LOST = "\ufffd"

# maximal runs of well-formed multibyte sequences (the table of the Unicode standard)
_SEQUENCE = rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
_SPAN = re.compile(rb"(?:" + _SEQUENCE + rb")+")

# characters a repair may bring: those of everyday text, in blocks
_EVERYDAY = (
    "\u0080-\u017f\u0192\u02c6\u02dc\u01a0\u01a1\u01af\u01b0\u0218-\u021b\u0300-\u030c\u0327\u0328\u0370-\u03e1\u0400-\u045f\u0490\u0491\u05d0-\u05ea\u0600-\u06ff\u0900-\u0dff\u0e00-\u0e7f"
    "\u1100-\u11ff\u1e00-\u1eff\u200c\u200d\u2010-\u2044\u20ac\u2116\u2122\u2190-\u21ff\u2600-\u27bf\u3000-\u30ff\u3130-\u318f\u3400-\u9fff\uac00-\ud7a3\ufe0f\uff01-\uffee\U0001f000-\U0001faff"
)
_FINE = re.compile(f"[{_EVERYDAY}]+")
_PLAIN_CYRILLIC = re.compile("[\u0410-\u044f\u0401\u0451\u00a0\u00ad]+")
_MAX_ROUNDS = 3

# signs that plain text does not have inside words: controls, private use, box drawing, lost characters;
# a symbol between two letters; two symbols in a row; a symbol that opens a word
_SIGN = "\u00a1-\u00ac\u00ae-\u00b6\u00b8-\u00bf\u00d7\u00f7\u02c6\u02dc\u201a\u201c-\u201e\u2020-\u2022\u2030\u2039\u203a\u20a7\u20ac\u2122\u2202\u220f\u2211\u221a\u221e\u222b\u2229\u2248\u2260-\u2265\u2310\u2320\u2321\u25ca"
_PAIR = "\u00a2\u00a4-\u00a9\u00ac\u00ae-\u00b6\u00b8\u00b9\u00bc-\u00be\u00d7\u00f7\u02c6\u02dc\u2020-\u2022\u2030\u20ac\u2122\u2202\u220f\u2211\u221a\u221e\u222b\u2248\u2260-\u2265"
_OPEN = "\u00a4\u00a6\u00a8\u00ac\u00af\u00b4\u00b8\u02c6\u02dc\u2020\u2021\u2030\u2122"
# every alternative begins with the character beyond ASCII that gives it away
ODD_PATTERN = (
    "[\u0080-\u009f\ue000-\uf8ff\u2500-\u259f]|\ufffd.|[\uff61-\uff9f]\ufffd"
    f"|(?<=\\p{{L}})[{_SIGN}]+\\p{{L}}|[{_PAIR}]{{2}}|(?<=^|[ /_])[{_OPEN}]\\p{{L}}|(?<=\\p{{Ll}})[\u00c2-\u00c5]\\p{{Ll}}"
)


def byte_map(codec: str) -> dict[str, bytes]:
    """The characters of an encoding beyond ASCII, with their bytes."""
    out: dict[str, bytes] = {}
    if codec == "western":  # windows-1252, with the controls of latin-1 where it has none
        for b in range(128, 256):
            out[chr(b)] = bytes([b])
        for b in range(128, 160):
            try:
                out[bytes([b]).decode("cp1252")] = bytes([b])
            except UnicodeDecodeError:
                pass
        return out
    for b in range(128, 256):
        try:
            out.setdefault(bytes([b]).decode(codec), bytes([b]))
        except UnicodeDecodeError:
            pass
    if codec in DOUBLE:
        for a in range(0x81, 0xFF):
            for b in range(0x40, 0xFF):
                try:
                    c = bytes([a, b]).decode(codec)
                except UnicodeDecodeError:
                    continue
                if len(c) == 1:
                    out.setdefault(c, bytes([a, b]))
    return {c: b for c, b in out.items() if len(c) == 1 and c != LOST}


@lru_cache(maxsize=None)
def _maps() -> dict[str, dict[str, bytes]]:
    return {c: byte_map(c) for c in SINGLE + DOUBLE}


def script(c: str) -> str:
    """A coarse script of a letter; '' for anything else."""
    if not c.isalpha():
        return ""
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o <= 0x1EFF:
        return "latin" if c not in "ªºµ" else ""
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "greek"
    if 0x400 <= o <= 0x52F:
        return "cyrillic"
    if 0x3040 <= o <= 0x30FF or 0x31F0 <= o <= 0x31FF or 0x3400 <= o <= 0x9FFF or 0xFF66 <= o <= 0xFF9F or 0xF900 <= o <= 0xFAFF:
        return "han"
    if 0xAC00 <= o <= 0xD7A3 or 0x1100 <= o <= 0x11FF or 0x3130 <= o <= 0x318F:
        return "hangul"
    return unicodedata.name(c, "?").split()[0].lower()


def _scripts(s: str) -> set[str]:
    return {x for x in map(script, s) if x}


_WORD = re.compile(r"[^\s_/.,()\d-]+")


def _word_around(s: str, a: int, b: int, stop: dict = {}) -> str:  # noqa: B006
    while a > 0 and (s[a - 1].isalpha() or unicodedata.combining(s[a - 1])) and s[a - 1] not in stop:
        a -= 1
    while b < len(s) and (s[b].isalpha() or unicodedata.combining(s[b])) and s[b] not in stop:
        b += 1
    return s[a:b]


def _decode_once(s: str, codec: str) -> tuple[str, int, int] | None:
    """(repaired, characters explained, characters made) by one encoding, or None."""
    m = _maps()[codec]
    raw, at = bytearray(), []
    for i, c in enumerate(s):
        b = c.encode() if c < "\x80" else m.get(c, b"\xff")
        raw += b
        at += [i] * len(b)
    at.append(len(s))
    raw = bytes(raw)
    out, last, explained, made = [], 0, 0, 0
    for x in _SPAN.finditer(raw):
        a, b = x.start(), x.end()
        # whole characters only: drop sequences that begin or end within a two-byte character
        if a and at[a] == at[a - 1]:
            a = next((k for k in range(a, b) if at[k] != at[k - 1] and raw[k] >= 0xC2), b)
        if b < len(raw) and b > a and at[b] == at[b - 1]:
            e = b
            while b < len(at) - 1 and at[b] == at[b - 1] and raw[b] < 0x80:
                b += 1  # an ASCII second byte was eaten by the wrong decoder
            if at[b] == at[b - 1]:
                b = e
                while b > a and (at[b] == at[b - 1] or (b < len(raw) and 0x80 <= raw[b] < 0xC0)):
                    b -= 1
        if b <= a:
            continue
        try:
            text = raw[a:b].decode()
        except UnicodeDecodeError:
            continue
        i, j = at[a], at[b]
        old = s[i:j]
        if not _FINE.fullmatch("".join(c for c in text if c >= "\x80") or "\xa0"):
            continue
        before, after = s[:i], s[j:]
        word = _word_around(before + text + after, i, i + len(text), m)
        mixed = _scripts(word)
        if len(mixed) > 1 and not mixed <= {"hangul", "han"}:
            continue  # a repair does not mix scripts within a word
        if codec in CYRILLIC and _scripts(_word_around(s, i, j)) == {"cyrillic"} and _PLAIN_CYRILLIC.fullmatch(old):
            continue  # a plain word of Cyrillic letters
        if codec in DOUBLE:
            kinds = _scripts(_word_around(s, i, j))
            halfwidth = any("｡" <= c <= "ﾟ" for c in old)
            lone = kinds <= {"han"} or kinds <= {"hangul"}
            if lone and not halfwidth and len(text) < (2 if _scripts(text) & {"han", "hangul"} else 3):
                continue
            if lone and not halfwidth and not any(script(c) for c in text):
                continue
        out += [s[last:i], text]
        last = j
        explained += j - i
        made += len(text)
    if not explained:
        return None
    return "".join(out) + s[last:], explained, made


def _strange(s: str) -> int:
    """Characters that everyday text of one language does not have, for choosing between repairs."""
    n = 0
    for c in s:
        if c >= "\x80":
            k = unicodedata.category(c)
            n += 2 * (k in ("Cc", "Cn", "Co")) + (k in ("So", "Sm", "Sc", "Sk", "No", "Lo") and not script(c)) + ("─" <= c <= "▟") + ("｡" <= c <= "ﾟ")
    return n


def repair(s: str | None) -> tuple[bool, str | None, str]:
    """(garbled, repaired or unchanged text, the encodings undone) of one value.

    A value with signs that plain text does not have is garbled even where no span can be decoded again; what
    was lost to U+FFFD stays lost. Null, empty and ASCII values are never garbled.
    """
    if s is None or s.isascii():
        return False, s, ""
    path: list[str] = []
    now = s
    for _ in range(_MAX_ROUNDS):
        if now.isascii():
            break
        tries = []
        for k, codec in enumerate(SINGLE + DOUBLE):
            if r := _decode_once(now, codec):
                tries.append(((_strange(r[0]), -r[1], k), r[0], codec))
        tries = [t for t in tries if t[0][0] <= _strange(now)]
        if not tries:
            break
        _, now, codec = min(tries)
        path.append(codec)
    odd = bool(_ODD.search(s))
    return bool(path) or odd, now, ">".join(path + ["odd"] * (odd and not path))


_ODD = regex.compile(ODD_PATTERN)


def _char_class(chars) -> str:
    points = sorted({ord(c) for c in chars})
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:x}}}" + (f"-\\x{{{points[j]:x}}}" if j > i else ""))
        i = j + 1
    return "[" + "".join(out) + "]"


@lru_cache(maxsize=None)
def suspicion_pattern() -> str:
    """A regular expression (Java) that holds for every value repair() could change: the automaton over characters.

    For one-byte encodings it spells the lead and continuation classes; for two-byte encodings it asks for
    ideographs or halfwidth letters, which hold their bytes.
    """
    parts = [ODD_PATTERN]
    for codec in SINGLE:
        m = byte_map(codec)
        cls = lambda lo, hi, m=m: _char_class(c for c, b in m.items() if lo <= b[0] <= hi)
        cont = cls(0x80, 0xBF)
        parts += [cls(0xC2, 0xDF) + cont, cls(0xE0, 0xEF) + cont + "{2}", cls(0xF0, 0xF4) + cont + "{3}"]
    # two-byte encodings write lead bytes as ideographs or halfwidth letters
    parts.append("[\\u3400-\\u9fff\\uff61-\\uff9f]")
    # nothing begins at an ASCII character, so those are passed by one test each
    return "(?=[^\\x00-\\x7f])(?:" + "|".join(parts) + ")"


def suspicious(col: F.Column) -> F.Column:
    """True where a value may be garbled; false values need no Python."""
    return F.coalesce((F.length(col) != F.octet_length(col)) & F.rlike(col, F.lit(suspicion_pattern())), F.lit(False))


REPAIR_SCHEMA = T.StructType([T.StructField("garbled", T.BooleanType()), T.StructField("fixed", T.StringType()), T.StructField("path", T.StringType())])


@F.pandas_udf(REPAIR_SCHEMA)
def repair_udf(values: pd.Series) -> pd.DataFrame:
    """repair() of each value, Arrow-batched; equal values of a batch are done once."""
    done = {v: repair(v) for v in set(values)}
    return pd.DataFrame([done[v] for v in values], columns=["garbled", "fixed", "path"])


@F.pandas_udf(REPAIR_SCHEMA)
def repair_path_udf(values: pd.Series) -> pd.DataFrame:
    """repair() of each segment of paths, joined again."""
    seen: dict[str, tuple] = {}
    rows = []
    for v in values:
        parts = []
        for p in v.split("/"):
            if p not in seen:
                seen[p] = repair(p)
            parts.append(seen[p])
        rows.append((any(p[0] for p in parts), "/".join(p[1] for p in parts), ";".join(p[2] for p in parts if p[2])))
    return pd.DataFrame(rows, columns=["garbled", "fixed", "path"])


# encodings that a word may have had, and encodings it may have been read in instead
TRUE_CODECS = ("cp1252", "cp437", "cp850", "cp852", "mac_roman", "cp1250", "iso8859_2", "cp1254", "cp1251", "cp866", "koi8_r", "cp1253", "iso8859_7", "cp932", "euc_jp", "cp949", "gbk", "big5", "utf_8")
READ_CODECS = ("western", "cp437", "cp850", "mac_roman", "cp1251", "cp866", "koi8_r", "cp1250", "cp1253", "cp1254", "cp932", "gbk", "cp949", "big5")
_BREAKS = " /._,()0-9-"
WORD_BREAK = f"[{_BREAKS}]+"


@lru_cache(maxsize=None)
def _read_map(codec: str) -> dict[str, bytes]:
    return byte_map(codec)


def word_candidates(word: str) -> set[str]:
    """What a word may have been before its bytes were read in another encoding: words of letters of one script."""
    out = set()
    for codec in READ_CODECS:
        m = _read_map(codec)
        try:
            raw = b"".join(c.encode() if c < "\x80" else m[c] for c in word)
        except KeyError:
            continue
        for true in TRUE_CODECS:
            try:
                c = raw.decode(true)
            except UnicodeDecodeError:
                continue
            if c != word and any(x >= "\x80" for x in c) and all(x.isalpha() or x == "'" for x in c) and len(_scripts(c)) == 1:
                out.add(c)
    return out


def words_of(*cols: F.Column) -> F.Column:
    """Distinct words with characters beyond ASCII of some columns; nulls have none."""
    parts = F.split(F.concat_ws(" ", *cols), WORD_BREAK)
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) != F.octet_length(w)))


def word_counts(corpus: DataFrame) -> DataFrame:
    """(word, n, values) of the words beyond ASCII in all columns of a table: the rows that have it, and the distinct path parts that do.

    Parts are counted before their words are, so that a folder that holds a third of the rows is one line.
    """
    parts = F.flatten(F.array(*(F.split(F.coalesce(F.col(c), F.lit("")), "/") for c in corpus.columns)))
    odd = F.filter(parts, lambda p: F.length(p) != F.octet_length(p))
    counted = corpus.select(F.explode(F.array_distinct(odd)).alias("part")).groupBy("part").agg(F.count("*").alias("c"))
    return counted.select("c", F.explode(words_of(F.col("part"))).alias("word")).groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("values"))


def word_repairs(words: DataFrame, min_count: int = 3, ratio: float = 3.0) -> DataFrame:
    """(word, fixed): words of one legacy encoding read in another, with the common word each stands for.

    words: (word, n, values) of the whole corpus. A word is garbled if one of its candidates is a word of the corpus
    at least min_count times and ratio times as frequent, by rows or by distinct values: a garbled folder may hold more
    rows than its right name has, but it is one value. The most frequent candidate is taken, ties by order. Words of
    one character are never garbled by themselves.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, n, v, c) for w, n, v in zip(b["word"], b["n"], b["values"]) if len(w) > 1 for c in word_candidates(w)]
            yield pd.DataFrame(rows, columns=["word", "n", "values", "fixed"])

    made = words.select("word", "n", "values").mapInPandas(run, "word string, n long, values long, fixed string")
    known = words.where(F.col("n") >= min_count).select(F.col("word").alias("fixed"), F.col("n").alias("m"), F.col("values").alias("mv"))
    by_values = (F.col("mv") >= min_count) & (F.col("mv") >= ratio * F.col("values"))
    by_rows = (F.col("m") >= ratio * F.col("n")) & (F.col("mv") >= F.col("values"))
    hits = made.join(known, "fixed").where(by_rows | by_values)
    return hits.groupBy("word").agg(F.max_by("fixed", F.struct("mv", "m", "fixed")).alias("fixed"))


def find(values: DataFrame, fields: dict[str, bool], corpus: DataFrame | None = None, broadcast_words: int = 200_000) -> DataFrame:
    """(rec_id, field, value, fixed, path): the garbled values of some columns.

    values: rec_id and the columns named in fields (True: a path, whose segments are judged one by one). Other
    columns are ignored. Null, empty and ASCII values are never garbled; repeated rows give repeated results
    only if their rec_id differs. corpus: the columns whose words count, if other than the values. Three passes: the words of the corpus are counted, their repairs found, and
    every value is judged by its spans, by signs that plain text does not have, and by its words.
    """
    from darkslide.session import cut

    values = values.select("rec_id", *fields)
    corpus = values.select(*fields) if corpus is None else corpus
    counted = cut(word_counts(corpus), "words")
    bad = cut(word_repairs(counted), "word-repairs")
    small = bad.limit(broadcast_words + 1).count() <= broadcast_words
    bad_side = F.broadcast(bad) if small else bad
    out = []
    for field, is_path in fields.items():
        one = values.select("rec_id", F.col(field).alias("value")).where(F.length("value") != F.octet_length("value"))
        spans = one.where(suspicious(F.col("value"))).withColumn("r", (repair_path_udf if is_path else repair_udf)("value")).where("r.garbled")
        spans = spans.select("rec_id", "value", F.col("r.fixed").alias("fixed"), F.col("r.path").alias("path"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("to"))
        words = one.withColumn("word", F.explode(words_of(F.col("value"))))
        if small:
            words = words.join(bad_side.withColumnRenamed("fixed", "to"), "word")
        else:  # words travel without their values, which are fetched for the few that are garbled
            words = words.select("rec_id", "word").join(bad_side.withColumnRenamed("fixed", "to"), "word").join(one, "rec_id")
        words = words.select("rec_id", "value", F.lit(None).cast("string").alias("fixed"), F.lit(None).cast("string").alias("path"), "word", "to")
        out.append(spans.unionByName(words).withColumn("field", F.lit(field)))
    hits = out[0]
    for x in out[1:]:
        hits = hits.unionByName(x)
    # one value has few words, so its group is small; spans come first, words are then put right one after the other
    hits = hits.groupBy("rec_id", "field").agg(F.max("value").alias("value"), F.max("fixed").alias("fixed"), F.max("path").alias("path"), F.collect_set(F.when(F.col("word").isNotNull(), F.struct("word", "to"))).alias("words"))
    # a word of two characters fits too much by chance: it counts only beside other evidence
    hits = hits.where(F.col("path").isNotNull() | F.exists("words", lambda w: F.length(w["word"]) > 2))
    fixed = F.aggregate(F.array_sort("words"), F.coalesce("fixed", "value"), lambda t, w: F.regexp_replace(t, F.concat(F.lit("(?<![^" + _BREAKS + "])\\Q"), w["word"], F.lit("\\E(?![^" + _BREAKS + "])")), w["to"]))
    return hits.select("rec_id", "field", "value", fixed.alias("fixed"), F.concat_ws(";", F.nullif("path", F.lit("")), F.when(F.size("words") > 0, F.lit("words"))).alias("path"))
