"""One consistent form for texts that look the same.

Three steps: compatibility forms (full width, styled letters, odd spaces and hyphens) become ordinary ones and
letters are composed; characters that show nothing are deleted, but for joiners that a script or an emoji
needs; then each word becomes a lattice of its letters and their look-alikes in other scripts, and a Viterbi
search takes the path with the best score under character bigrams of one script at a time.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkslide.llm import mojibake

# Letters of other scripts that look like a Latin letter.
CYRILLIC_LATIN = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅЁёЇї", "aeopcyxijshdqwABEKMHOPCTYXIJSËëÏï"))
GREEK_LATIN = dict(zip("οανρυικχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧόάίύ", "oavpuikxyABEZHIKMNOPTYXóáíú"))
SCRIPTS = ("latin", "cyrillic", "greek")

# Code points that show nothing, as ranges.
IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010-\u2012\u2212\ufe58\ufe63\uff0d"
# forms that stand for an ordinary character: half and full width, styled, enclosed, ligatures, compatibility ideographs and radicals
COMPAT = "\u2100-\u2115\u2117-\u2121\u2123-\u214f\u2160-\u217f\u2460-\u24ff\u2e80-\u2fdf\u3200-\u33ff\uf900-\ufaff\ufb00-\ufb4f\uff01-\uffdc\uffe0-\uffee\U0001d400-\U0001d7ff"
MARKS = "\u0300-\u034e\u0350-\u036f\u3099\u309a\u1100-\u115e\u1161-\u11ff"

_IGNORABLE = re.compile(f"[{IGNORABLE}]")
_SPACE = re.compile(f"[{SPACES}]")
_HYPHEN = re.compile(f"[{HYPHENS}]")
_COMPAT = re.compile(f"[{COMPAT}]+")
_WORD = re.compile(r"[^\W\d_]+")
_JOINED_SCRIPTS = re.compile("[\u0590-\u08ff\u0900-\u0dff\u0f00-\u109f\u1780-\u17ff\u1800-\u18af]")


def _emoji(c: str) -> bool:
    o = ord(c)
    return o >= 0x1F000 or 0x2190 <= o <= 0x2BFF or o in (0x200D, 0xFE0F, 0xA9, 0xAE, 0x203C, 0x2049, 0x3030, 0x303D, 0x3297, 0x3299) or 0x1F3FB <= o <= 0x1F3FF


def _needed(s: str, i: int) -> bool:
    """Whether the ignorable at i is one that its neighbours need."""
    c, before, after = s[i], s[i - 1 : i], s[i + 1 : i + 2]
    if c == "\u200d":
        return bool(before and after) and (bool(_JOINED_SCRIPTS.match(before)) or (_emoji(before) and _emoji(after)))
    if c == "\u200c":
        return bool(before and after) and bool(_JOINED_SCRIPTS.match(before)) and bool(_JOINED_SCRIPTS.match(after))
    if c in "\ufe0e\ufe0f":
        return bool(before) and (_emoji(before) or before in "0123456789#*")
    return False


def ordinary(s: str) -> str:
    """The value with ordinary letters, spaces and hyphens, composed, and without what shows nothing."""
    s = _IGNORABLE.sub(lambda m: m[0] if _needed(s, m.start()) else "", s)
    s = _HYPHEN.sub("-", _SPACE.sub(" ", s))
    return unicodedata.normalize("NFC", _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m[0]), s))


@lru_cache(maxsize=None)
def _options(c: str) -> tuple[tuple[str, str], ...]:
    """(letter, script) choices of a letter: itself and what looks like it in the other scripts."""
    out = [(c, mojibake.script(c))]
    latin = CYRILLIC_LATIN.get(c) or GREEK_LATIN.get(c)
    if latin:
        out.append((latin, "latin"))
    base = latin or c
    for script, table in (("cyrillic", CYRILLIC_LATIN), ("greek", GREEK_LATIN)):
        out += [(k, script) for k, v in table.items() if v == base and k != c]
    return tuple(out)


class Bigrams:
    """Log chances of letters after letters, per script, with add-half smoothing; '^' and '$' bound a word."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.pair = counts
        self.total: dict[tuple[str, str], int] = {}
        kinds: dict[str, set] = {}
        for (s, a, b), n in counts.items():
            self.total[s, a] = self.total.get((s, a), 0) + n
            kinds.setdefault(s, set()).add(b)
        self.kinds = {s: len(k) + 1 for s, k in kinds.items()}

    def __call__(self, script: str, a: str, b: str) -> float:
        return math.log((self.pair.get((script, a, b), 0) + 0.5) / (self.total.get((script, a), 0) + 0.5 * self.kinds.get(script, 50)))


SWITCH, SWAP, FOREIGN = -25.0, -2.0, -8.0


def best_word(word: str, context: set[str], model: Bigrams) -> str:
    """The best path through the look-alike lattice of a word. context: scripts that other words of the value are surely in."""
    rows = [_options(c) for c in word]
    low = [[o[0].lower() for o in r] for r in rows]
    score = [[(0.0 if not context or s in context else FOREIGN) + (SWAP if k else 0.0) + model(s, "^", low[0][k]) for k, (_, s) in enumerate(rows[0])]]
    back: list[list[int]] = []
    for i in range(1, len(rows)):
        line, from_ = [], []
        for k, (_, s) in enumerate(rows[i]):
            steps = [score[-1][j] + (model(s, low[i - 1][j], low[i][k]) if rows[i - 1][j][1] == s else SWITCH) for j in range(len(rows[i - 1]))]
            j = max(range(len(steps)), key=lambda j: (steps[j], -j))
            line.append(steps[j] + (SWAP if k else 0.0))
            from_.append(j)
        score.append(line)
        back.append(from_)
    last = [v + model(rows[-1][k][1], low[-1][k], "$") for k, v in enumerate(score[-1])]
    k = max(range(len(last)), key=lambda k: (last[k], -k))
    path = [k]
    for from_ in reversed(back):
        path.append(from_[path[-1]])
    path.reverse()
    return "".join(rows[i][k][0] for i, k in enumerate(path))


_AMBIGUOUS = {*CYRILLIC_LATIN, *GREEK_LATIN, *CYRILLIC_LATIN.values(), *GREEK_LATIN.values()}
_EXTENSION = re.compile(r"(\.[A-Za-z0-9-]{1,24}){0,3}$")


def plain(s: str | None, model: Bigrams) -> str | None:
    """The consistent form of a value. Null and empty values are their own form; a trailing extension gives no context."""
    if not s or s.isascii():
        return s
    t = ordinary(s)
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(t)]
    if not any("Ͱ" <= c <= "ԯ" for c in t):
        return t
    stem = len(t) - len(_EXTENSION.search(t)[0])
    # a word is surely in a script if it has a letter that no other script has a look-alike of
    sure = []
    for a, _, w in words:
        kinds = {mojibake.script(c) for c in w if c not in _AMBIGUOUS} - {""}
        sure.append(kinds if a < stem else set())
    out, last = [], 0
    for i, (a, b, w) in enumerate(words):
        kinds = {mojibake.script(c) for c in w} - {""}
        if not kinds <= set(SCRIPTS):
            continue
        context = set().union(*(k for j, k in enumerate(sure) if j != i)) if not sure[i] else set()
        if len(kinds) > 1 or (context and not kinds & context):
            fixed = best_word(w, context, model)
            if fixed != w and len({mojibake.script(c) for c in fixed} - {""}) == 1:
                out += [t[last:a], fixed]
                last = b
    return "".join(out) + t[last:]


def doubtful(col: F.Column) -> F.Column:
    """True for every value that plain() could change; the rest needs no Python."""
    latin = "A-Za-zÀ-ɏ\u1e00-\u1eff"
    other = "Ͱ-ϿЀ-ԯ"
    amb = "".join([*CYRILLIC_LATIN, *GREEK_LATIN])
    lat = "".join(sorted({*CYRILLIC_LATIN.values(), *GREEK_LATIN.values()}))
    forms = f"[{IGNORABLE}{SPACES}{HYPHENS}{COMPAT}{MARKS}]"
    words = f"[{latin}][{other}]|[{other}][{latin}]|(?<![{other}])[{amb}]+(?![{other}])"
    latin_words = f"(?<![{latin}.])[{lat}]+(?![{latin}])"
    return F.coalesce(F.rlike(col, F.lit(forms)) | (F.rlike(col, F.lit(f"[{other}]")) & F.rlike(col, F.lit(f"{words}|{latin_words}"))), F.lit(False))


def bigrams(values: DataFrame, cols: list[str]) -> dict[tuple[str, str, str], int]:
    """Bigram counts by script over the words of all values, weighted by how often a word occurs.

    Words of more than one script are left out. What is collected is bounded by the squares of three alphabets,
    whatever the size of the table.
    """
    letters = "A-Za-zÀ-ɏ\u1e00-\u1eff"
    ranges = {"latin": letters, "cyrillic": "Ѐ-ԯ", "greek": "Ͱ-Ͽ\u1f00-\u1fff"}
    words = values.select(F.explode(F.split(F.concat_ws(" ", *cols), "[^\\p{L}]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    script = F.coalesce(*(F.when(F.rlike("word", F.lit(f"^[{r}]+$")), F.lit(s)) for s, r in ranges.items()))
    words = words.withColumn("script", script).where("script is not null").withColumn("w", F.concat(F.lit("^"), F.lower("word"), F.lit("$")))
    pairs = words.select("script", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("p"))
    rows = pairs.groupBy("script", "p").agg(F.sum("n").alias("n")).where(F.length("p") == 2).collect()
    return {(r.script, r.p[0], r.p[1]): r.n for r in rows}


def canonical(values: DataFrame, fields: list[str]) -> DataFrame:
    """(rec_id, field, value, plain): values whose consistent form differs from them, garbled values left out.

    values: rec_id and the fields; other columns are ignored. Null, empty and ASCII values are their own form.
    Values equal in form compare equal afterwards, so repeated rows and ties need no choice.
    """
    values = values.select("rec_id", *fields)
    model = Bigrams(bigrams(values, fields))

    @F.pandas_udf(T.StringType())
    def plain_udf(s: pd.Series) -> pd.Series:
        done = {v: plain(v, model) for v in set(s)}
        return pd.Series([done[v] for v in s], dtype=object)

    parts = [values.select("rec_id", F.lit(f).alias("field"), F.col(f).alias("value")).where(F.length("value") != F.octet_length("value")).where(doubtful(F.col("value"))) for f in fields]
    doubt = parts[0]
    for p in parts[1:]:
        doubt = doubt.unionByName(p)
    changed = doubt.withColumn("plain", plain_udf("value")).where("plain <> value")
    bad = mojibake.find(changed.select(F.concat_ws(":", "field", F.col("rec_id").cast("string")).alias("rec_id"), "value"), {"value": False}, corpus=values.select(*fields))
    bad = bad.select(F.col("rec_id").alias("_key"))
    return changed.join(bad, F.concat_ws(":", "field", F.col("rec_id").cast("string")) == F.col("_key"), "left_anti")
