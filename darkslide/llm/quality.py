"""Text statistics per document, and a Gaussian mixture that tells prose from lists, tables and junk.

A document is read in blocks (paragraphs between blank lines), as a page may hold a sentence and a table. The
same statistics are taken of blocks and of whole documents. A mixture with diagonal covariances is fitted to the
standardized statistics of all blocks by expectation-maximisation; each iteration is one pass that sends sums per
component, never rows, to the driver. Inspected examples start the components and name them afterwards.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.session import cut

_LINK = re.compile(r"https?://\S+")
_BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_LINE_BLANKS = " \t\u00a0\u3000"  # a line of these alone parts two blocks
_ENDS, _CLOSERS = ".!?…。！？।؟:;", "\"'”’»“)]"
_QUIET = ".,!?…。、！？'’\"“”„«»–—-()\u200d\ufe0f"
_MARKS = "-*•‣·+"

STATS = ("log_words", "word_length", "symbols", "digits", "common", "ends", "unique", "separators", "marks", "upper", "rare")

# Inspected examples, by kind: (kind, text). Each group starts one component.
EXAMPLES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("prose", ("We walked along the river until it was dark. The old mill was closed, but the lights were on and somebody was playing the piano.", "This is the house that my aunt bought in 1971. She never told us why the garden had two gates, and nobody asked her.", "Es hat den ganzen Tag geregnet. Wir haben auf den Zug gewartet, und die Kinder waren müde.", "Nous avons pris le train de nuit pour aller à la mer. Le matin était froid, mais il y avait du soleil.")),
    ("prose", ("the camera was left on the table and nobody knew who had taken the last of the pictures because the film was new", "wir wollten noch vor dem abend zurück sein aber der weg war länger als auf der karte", "мы вернулись домой и пили чай на веранде потому что было ещё тепло")),
    ("prose", ("昨日は雨だったので、家で古い写真を整理していました。母はとても喜んでいました。", "この道をまっすぐ行くと、小さな橋があります。そこで写真を撮りました。")),
    ("prose", ("「その手紙はもう読みましたか。」\n「いいえ、まだ読んでいません。」", "– この写真はどこで撮りましたか。\n– 丘の上の神社で撮りました。", "\"去年の夏に駅で撮りました。\"\n\"とても暑い日でした。\"")),
    ("prose", ("Весной мы посадили яблоню у старого забора. Соседи помогали нам весь день.", "Поезд опоздал на два часа. Дети спали, а дедушка читал газету.", "Вечером стало холодно, и мы зажгли печь.")),
    ("prose", ("we took the long way home and the long way was full of snow and the snow was deep so the car stood at the gate and the car stayed there for the night and in the morning the snow was deep and the gate was shut and we took the long way again and nobody was at the gate and the long way was full of snow", "ich habe den alten koffer auf dem boden gefunden und der koffer war voll mit bildern und die bilder waren alle ohne datum und ich habe die bilder auf den tisch gelegt und der koffer war leer und die bilder waren alle ohne namen")),
    ("prose", ("if you have lost the key, ask at the desk for another one and come back before noon the boat leaves at 9 and the next one at 11, so do not be late it took 20 minutes to find the right pier, but the view was worth it the boat leaves at 9 and the next one at 11, so do not be late if the weather is bad, the boat stays in the harbour and you will get your money back did you ask at the desk for another key, or is it still in the car? the man at the desk said that 12 people had lost the key this year", "wer den zug verpasst hat, muss bis 18 uhr warten, denn am abend fährt nur noch einer der zug hält nicht an jedem bahnhof, und im winter gar nicht wir haben 40 minuten gewartet, bis jemand kam, aber der blick war schön wer den zug verpasst hat, muss bis 18 uhr warten, denn am abend fährt nur noch einer hat jemand den schlüssel gesehen, oder liegt er noch im auto?", "si llega tarde el barco, espere en el muelle y no compre otro billete el barco sale a las 9 y el otro a las 11, y en invierno no sale tardamos 20 minutos en llegar, pero la vista era muy buena el barco sale a las 9 y el otro a las 11, y en invierno no sale ha visto alguien la llave, o está en el coche?")),
    ("prose", ("昨日は雨でした。  母は家で写真を見ていました。  昨日は雨でした。  父は駅まで歩きました。\n昨日は雨でした。  母は家で手紙を書いていました。  父は駅まで歩きました。  母は家で写真を見ていました。", "今日は風が強い https://example.invalid/x から、海には行きませんでした。 🙂 家で古い写真を整理しました。 —\n明日は晴れるといいですね。 …")),
    ("prose", ("What a day! 🙂 See https://example.invalid/a for the rest of it.", "The last boat of the summer. 📷", "We met at the station again.")),
    ("prose", ("– Did you see the letter that came with the pictures?\n– No, I was not at home when it came.\n– Then it must still be in the box.", "\"I do not know where this was taken.\"\n\"It was on the hill, in the summer before we moved.\"")),
    ("prose", ("The ship left the harbour at noon and we stood on\nthe pier until it was gone. My brother had the only\ncamera and used the last of the film on the gulls, so\nthere is no picture of the ship.", "Das Haus am See wurde im Winter verkauft, und die neuen\nBesitzer haben den Garten ganz anders angelegt als er auf\nden Bildern zu sehen ist.")),
    ("list", ("- Apples\n- Lamp oil\n- Blue blanket\n- Tripod", "* Garden\n* Harbour\n* Old church\n* Station", "[x] Pack the tent, Norway\n[ ] Call Anna, home\n[x] Scan slides, attic")),
    ("list", ("1. Castle Hill\n2. Market Square\n3. Boat House\n4. Lower Bridge\n5. Mill Lane", "1. Schloss\n2. Marktplatz\n3. Bootshaus\n4. Untere Brücke")),
    ("list", ("Castle Hill\nMarket Square\nBoat House\nLower Bridge\nMill Lane\nHarbour", "Schloss\nMarktplatz\nBootshaus\nStraße\nKirche", "Castle, Market, Boats, Bridge, Mill, Harbour, Church, Station, Garden", "Sunset, Sunset, Castle, Boats, Sunset, Castle")),
    ("list", ("海辺\n山の朝\n神社\n海辺\n公園", "海辺, 山の朝, 神社, 公園, 海辺, 山の朝", "お祭り\nスキー\n誕生日会")),
    ("list", ("1. 海辺 山の朝\n2. 神社 公園\n3. 海辺 公園\n4. 海辺 山の朝\n5. 神社 海辺", "1. お祭り 北町\n2. スキー 南町\n3. 誕生日会 北町\n4. スキー 北町")),
    ("list", ("IMG_2210.jpg\nIMG_2211.jpg\nDSC04410.JPG\nscan-118.tif", "VID_0091.mp4\nIMG_3310.heic\nIMG_3311.heic")),
    ("table", ("| 2019-04-02 | open | Lisbon |\n| 2019-04-03 | closed | Porto |\n| 2019-04-05 | open | Faro |", "|---|---|---|\n| 12.1 | a.jpg | 4400 |\n| 13.9 | b.jpg | 5100 |")),
    ("table", ("a.jpg,2019-04-02,12.1,ok\nb.jpg,2019-04-03,13.9,late\nc.jpg,2019-04-05,11.0,ok", "\"4400\";\"12.1\";\"Lisbon\";\"a.jpg\"\n\"5100\";\"13.9\";\"Porto\";\"b.jpg\"", "4400\ta.jpg\t2019-04-02\tok\n5100\tb.jpg\t2019-04-03\tlate")),
    ("table", ("Lisbon        2019-04-02     a.jpg      12.1\nPorto         2019-04-03     b.jpg      13.9\nFaro          2019-04-05     c.jpg      11.0", "ok       Lisbon       a.jpg\nlate     Porto        b.jpg\nok       Faro         c.jpg")),
    ("junk", ("10:22:31.004 INFO job=copy id=5512 err=0\n10:22:31.950 WARN job=copy id=5513 err=2\n10:22:33.120 DBG job=move id=5514 err=0", "12:00:01.100 WARN step=read file=a91 err=3\n12:00:02.000 INFO step=read file=a92 err=0")),
    ("junk", ("00000000  4a 7f 00 12 9c d4 e1 03 55 6a 70 81 92 a3 b4 c5\n00000010  0d 0a 1a 0a ff d8 ff e0 00 10 4a 46 49 46 00 01",)),
    ("junk", ("qL8fT0zXw2Rk5vYp9sNd3mHc7bJg1aUe6oIi4tKxQyWzEuRvTbYnUmIkOlPaSdFg\nHjKlZxCvBnMqWeRtYuIoPaSdFgHjKlZxCvBnM1234567890QwErTyUiOpAsDfGhJk", "loadloadloadloadloadloadloadloadloadloadloadloadloadloadloadloadload")),
    ("junk", ("********************\n____________________\n::::::::::::::::::::", "}{[]^~#%&@<>|$^~{}[]#9%7^&@1<4>|$%#\n#^~}{[2]@6&%$|<>^~#@[8]{5}%^&$#@~|<")),
    ("junk", ("zqkwj plrx vbnmt oiuwq xkcjv hgqpz wertk lmnvx qazpl okmij", "fjwq xkpl zzvba qiwoe rnmxk plokq wjhgf zxqvb nmkjq")),
    ("junk", ("hello hello hello hello hello hello hello hello hello hello hello hello", "ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok", "Datei Datei Datei Datei Datei Datei Datei Datei Datei Datei Datei Datei Datei Datei Datei Datei")),
)
KINDS = ("prose", "list", "table", "junk")


# classes of characters, one bit each
_WORD, _LETTER, _NUMBER, _OPENS, _BLANK, _CJK, _TRAILS, _CLOSES, _STOPS, _SYMBOL, _LATIN, _RARE, _INNER, _SEPARATES = (1 << i for i in range(14))
_CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(classes, lower-case letter) of every code point; those beyond the third plane have no class."""
    classes, lower = np.zeros(0x110000, np.uint16), np.arange(0x110000, dtype=np.uint32)
    chars = [chr(i) for i in range(0x40000)]
    kind = np.array([unicodedata.category(c) for c in chars])
    main = kind.astype("U1")
    point = np.arange(len(chars))
    one_of = lambda text: np.isin(point, _codes(text))
    within = lambda *spans: np.logical_or.reduce([(point >= ord(x)) & (point <= ord(y)) for x, y in spans])
    blank, letter = one_of(_BLANKS), main == "L"
    bits = {
        _WORD: letter | (main == "M"), _LETTER: letter, _NUMBER: main == "N", _OPENS: np.isin(kind, ["Lu", "Nd"]) | (main == "P") | (main == "S"), _BLANK: blank,
        _CJK: within(("\u3040", "\u30ff"), ("\u3400", "\u9fff")), _TRAILS: blank | np.isin(kind, ["So", "Sk"]) | (main == "M") | one_of("\u200d\ufe0f"), _CLOSES: one_of(_CLOSERS), _STOPS: one_of(_ENDS),
        _SYMBOL: ~(blank | letter | (main == "M") | (main == "N") | (kind == "So") | one_of(_QUIET)), _LATIN: within(("a", "z"), ("A", "Z")), _RARE: one_of("jkqvwxyzJKQVWXYZ"),
        _INNER: blank & ~one_of(_LINE_BLANKS), _SEPARATES: one_of(",;|\t"),
    }
    for bit, mask in bits.items():
        classes[: len(chars)] |= np.where(mask, np.uint16(bit), np.uint16(0))
    for i in np.flatnonzero(np.isin(kind, ["Lu", "Lt", "Nl", "So"])):
        if len(low := chars[i].lower()) == 1:
            lower[i] = ord(low)
    return classes, lower


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))])


def _word_hashes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that lie one after the other in codes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    most = 1 << int(sizes.max()).bit_length()
    with np.errstate(over="ignore"):
        at = np.arange(len(codes)) - np.repeat(starts, sizes)
        h = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * _powers(most)[at], starts) + sizes.astype(np.uint64)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _back(mask: np.ndarray) -> np.ndarray:
    """For every place the last place up to it where mask is true, -1 before the first."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask), dtype=np.int32), np.int32(-1)))


def measure(texts: list[str], common: frozenset[str], by_block: bool) -> pd.DataFrame:
    """The statistics of each text, or of each block of each text that is not blank: (at, no, n_chars, STATS...), at being the place in texts.

    All texts go as one array of code points, and every statistic is a few passes over its classes. A text ends its
    last line; carriage returns are line ends; web addresses count as blank, but in n_chars.
    """
    classes, lower = _tables()
    joined = "".join(t.replace("\r\n", "\n").replace("\r", "\n") + "\n" for t in texts)
    sizes = np.array([len(t) - t.count("\r\n") + 1 for t in texts], np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    inked = (classes[codes] & _BLANK) == 0
    if "http" in joined:
        for m in _LINK.finditer(joined):
            codes[m.start() : m.end()] = 0x2009
    k = classes[codes]
    blank = (k & _BLANK) != 0
    # lines, and the units they belong to
    text_start = np.cumsum(sizes) - sizes
    end = np.flatnonzero(codes == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    of_text = np.searchsorted(text_start, start, "right") - 1
    fresh = np.concatenate([[True], of_text[1:] != of_text[:-1]])
    if by_block:
        full = np.concatenate([[0], np.cumsum(inked | ((k & _INNER) != 0) & (codes != 10))])
        fresh |= full[end] == full[start]
    unit = np.cumsum(fresh) - 1
    n_units = int(unit[-1]) + 1
    unit_start = start[fresh]
    unit_at = of_text[fresh]
    total = lambda mask: np.add.reduceat(mask, unit_start, dtype=np.int64)
    tally = lambda units: np.bincount(units, minlength=n_units)
    has = lambda bit: total((k & bit) != 0)
    # tokens between blanks
    t0, t1 = _runs(~blank)
    line_of = np.searchsorted(start, t0, "right") - 1
    t_unit = unit[line_of]
    n_tokens = tally(t_unit)
    first = np.searchsorted(t0, start)
    held = (first < len(t0)) & (t0[np.minimum(first, max(len(t0) - 1, 0))] < end) if len(t0) else np.zeros(len(start), bool)
    start, end, l_unit, first = start[held], end[held], unit[held], first[held]
    head = t0[first] if len(t0) else first
    # how lines end: stops, then closing marks, then what trails
    last = _back((k & _TRAILS) == 0)[end - 1] if len(end) else end
    last = np.where(last >= start, _back((k & _CLOSES) == 0)[np.maximum(last, 0)], -1)
    stops = (last >= start) & ((k[np.maximum(last, 0)] & _STOPS) != 0)
    # list marks at the head of a line, with something after them
    padded = np.concatenate([codes, np.full(6, 10, np.uint32)])
    c = [padded[head + i] for i in range(5)]
    gap = [np.isin(x, _codes(_BLANKS)) & (x != 10) for x in c]
    digit = [(x >= 48) & (x <= 57) for x in c]
    dot = [(x == 46) | (x == 41) for x in c]
    numbered = digit[0] & (dot[1] & gap[2] | digit[1] & (dot[2] & gap[3] | digit[2] & dot[3] & gap[4]))
    boxed = (c[0] == 91) & ((c[1] == 93) & gap[2] | (c[2] == 93) & (c[1] != 10) & gap[3])
    more = (first + 1 < len(t0)) & (t0[np.minimum(first + 1, max(len(t0) - 1, 0))] < end) if len(t0) else held[held]
    marked = (np.isin(c[0], _codes(_MARKS)) & gap[1] | boxed | numbered) & more
    # lines spread over columns: tabs, separators without a space after them, or tokens between wide gaps
    nxt = np.concatenate([codes[1:], [10]])
    bar = codes == 124
    tight = (bar | (codes == 59) | (codes == 44)) & ~np.concatenate([blank[1:], [True]])
    quoted = np.flatnonzero(codes == 34)
    if len(quoted):
        solid = np.flatnonzero(codes != 32)
        after = np.searchsorted(solid, quoted, "right")
        quoted = quoted[(after < len(solid)) & (codes[solid[np.minimum(after, len(solid) - 1)]] == 59)]
    space = np.concatenate([[0], np.cumsum(codes == 32)])
    spots = [np.flatnonzero((codes == 9) | tight | (bar & (nxt == 32))), quoted]
    if len(t0) > 2:
        wide = (t0[1:] - t1[:-1] >= 2) & (space[t0[1:]] - space[t1[:-1]] == t0[1:] - t1[:-1])
        spots.append(t0[1:-1][wide[:-1] & wide[1:]])
    spread = np.zeros(len(start), bool)
    where = np.searchsorted(start, np.concatenate(spots), "right") - 1
    where = where[where >= 0]
    spread[where] = True
    # separators: single ones, wide gaps, and enumeration commas close to each other
    separators = has(_SEPARATES)
    s0, s1 = _runs(codes == 32)
    at_unit = lambda places: np.searchsorted(unit_start, places, "right") - 1
    separators = separators + tally(at_unit(s0[s1 - s0 >= 3]))
    commas = np.flatnonzero(codes == 0x3001)
    if len(commas) > 1:
        d, filled = np.diff(commas), np.concatenate([[0], np.cumsum(blank)])
        close = (d >= 2) & (d <= 7) & (filled[commas[1:]] == filled[commas[:-1]])
        separators = separators + tally(at_unit(commas[:-1][close]))
    # words of letters, an apostrophe between letters included
    letter = (k & _WORD) != 0
    apostrophe = (codes == 39) | (codes == 0x2019)
    apostrophe &= np.concatenate([[False], letter[:-1]]) & np.concatenate([(k[1:] & _LETTER) != 0, [False]])
    letter |= apostrophe
    w0, w1 = _runs(letter)
    size = w1 - w0
    hashes = _word_hashes(lower[codes[letter]], np.cumsum(size) - size, size)
    w_unit = at_unit(w0)
    with np.errstate(over="ignore"):
        keys = hashes ^ (w_unit.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    once = ~pd.Series(keys).duplicated().to_numpy()
    n_words, n_distinct = np.maximum(tally(w_unit), 1), tally(w_unit[once])
    spoken = [w for w in common if not any("\u3040" <= x <= "\u9fff" for x in w)]
    wanted = np.sort(_hash_of(spoken))
    known = once & (wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes) if len(wanted) else np.zeros(len(once), bool)
    known = tally(w_unit[known]) / np.maximum(n_distinct, 1)
    n_cjk = has(_CJK)
    cjk_at = np.flatnonzero((k & _CJK) != 0)
    hit = np.zeros(len(cjk_at), bool)
    for w in common - set(spoken):
        if w:
            hit |= np.logical_and.reduce([padded[np.minimum(cjk_at + i, len(padded) - 1)] == ord(x) for i, x in enumerate(w)])
    cjk_known = tally(at_unit(cjk_at[hit])) / np.maximum(n_cjk / 4, 1.0)
    n = np.maximum(total(~blank), 1)
    words = np.maximum(n_tokens + n_cjk / 2.5, 1.0)
    lines = np.maximum(tally(l_unit), 1)
    out = {
        "at": unit_at, "no": np.arange(n_units) - np.searchsorted(unit_at, unit_at), "n_chars": total(inked),
        "log_words": np.log1p(words), "word_length": np.log(np.minimum(n / words, 60.0) + 1), "symbols": np.minimum(has(_SYMBOL) / n, 0.4), "digits": np.minimum(has(_NUMBER) / n, 0.5),
        "common": np.minimum(np.where(n_cjk > n / 3, cjk_known, known), 0.6), "ends": tally(l_unit[stops]) / lines, "unique": n_distinct / n_words, "separators": np.minimum(separators / words, 1.2),
        "marks": np.minimum((tally(l_unit[marked]) + tally(l_unit[spread])) / lines, 1.0), "upper": tally(t_unit[(k[t0] & _OPENS) != 0]) / np.maximum(n_tokens, 1),
        # letters that are rare in languages of the Latin script, and frequent in strings of random ones
        "rare": np.minimum(has(_RARE) / np.maximum(has(_LATIN), 1), 0.4),
    }
    df = pd.DataFrame(out)
    return df[df["n_chars"] > 0] if by_block else df


@lru_cache(maxsize=8)
def _codes(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], np.uint32)


def _hash_of(words: list[str]) -> np.ndarray:
    size = np.array([len(w) for w in words], np.int64)
    codes = np.array([ord(c) for w in words for c in w], np.uint32)
    return _word_hashes(codes, np.cumsum(size) - size, size) if words else np.zeros(0, np.uint64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about a million characters, with the place of the first; a longer text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def _common_words(common: DataFrame) -> frozenset[str]:
    """The distinct lower-case words of (lang, word), a fixed small table; null words are ignored."""
    return frozenset(r.word.lower() for r in common.select("word").where("word <> ''").distinct().collect())


def _measured(texts: DataFrame, common: DataFrame, by_block: bool) -> DataFrame:
    words, kind = _common_words(common), texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b["id"].to_numpy(), b["text"].tolist()
            for first, some in _chunks(texts):
                out = measure(some, words, by_block)
                out.insert(0, "id", ids[first + out.pop("at").to_numpy()])
                yield out

    return texts.select("id", "text").mapInPandas(run, f"id {kind}, no int, n_chars bigint, " + ", ".join(f"{c} double" for c in STATS))


def text_stats(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(id, n_chars, STATS...) of each text (id, text) as a whole; null texts have the statistics of an empty text. common: (lang, word)."""
    return _measured(docs.select("id", F.coalesce("text", F.lit("")).alias("text")), common, False).drop("no")


def block_stats(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(id, no, n_chars, STATS...) of every block (paragraph between blank lines) of every text that is neither null, empty nor blank; n_chars counts what is not white space."""
    return _measured(docs.where("text <> ''").select("id", "text"), common, True)


class Mixture:
    """A Gaussian mixture with diagonal covariances over standardized statistics; rounds and converged tell of its fit."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, centres: np.ndarray, spreads: np.ndarray, rounds: int = 0, converged: bool = False):
        self.mean, self.scale, self.weights, self.centres, self.spreads, self.rounds, self.converged = mean, scale, weights, centres, spreads, rounds, converged

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def log_shares(self, z: np.ndarray) -> np.ndarray:
        """Log of weight times density of each component, up to a constant: the squares multiplied out, so two matrix products."""
        exact = 1 / self.spreads
        own = np.log(self.weights) - 0.5 * (np.log(self.spreads) + self.centres**2 * exact).sum(axis=1)
        return own[None] + z @ (self.centres * exact).T - 0.5 * (z * z) @ exact.T

    def posterior(self, z: np.ndarray) -> np.ndarray:
        s = self.log_shares(z)
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)


def fit(rows: DataFrame, examples: list[np.ndarray], rounds: int = 300, least_spread: float = 0.08, most_spread: float = 0.5, tolerance: float = 1e-4) -> Mixture:
    """Expectation-maximisation over all rows (columns of STATS) until the mean log-likelihood rises by less than tolerance.

    The examples only start the components, one group each, and take no part in the rounds; a component that no row
    supports stays where it is with a weight of nearly nothing. Spreads are bounded on both sides: a wide component would
    else take in those of other kinds. A fit that `rounds` end before it has settled says so
    by a warning and in `converged`. An iteration sends one line of sums per component and partition, whose size does
    not depend on the rows. An empty table leaves the components at the examples.
    """
    cols = list(STATS)
    agg = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"s_{c}") for c in cols)).first()
    every = np.vstack(examples)
    mean = np.array([agg[f"m_{c}"] if agg[f"m_{c}"] is not None else every[:, i].mean() for i, c in enumerate(cols)])
    scale = np.array([max(agg[f"s_{c}"] or every[:, i].std(), 1e-3) for i, c in enumerate(cols)])
    k, d = len(examples), len(cols)
    m = Mixture(mean, scale, np.full(k, 1 / k), np.zeros((k, d)), np.full((k, d), 0.3))
    m.centres = np.array([m.standard(e).mean(axis=0) for e in examples])
    last = -np.inf

    def pack(batches: Iterator[pd.DataFrame], start: Mixture = m) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"z": [start.standard(b[cols].to_numpy(float)).astype(np.float32).tobytes()]})

    # the rounds read blocks of standardized rows, one value each, and none of the rows themselves
    packed = cut(rows.select(*cols).mapInPandas(pack, "z binary"), "packed")
    for done in range(1, rounds + 1):
        now = m

        def sums(batches: Iterator[pd.DataFrame], now: Mixture = now) -> Iterator[pd.DataFrame]:
            n, x, xx, ll, seen = np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), 0.0, 0
            for block in (z for b in batches for z in b["z"]):
                z = np.frombuffer(block, np.float32).reshape(-1, d).astype(float)
                s = now.log_shares(z)
                top = s.max(axis=1)
                p = np.exp(s - top[:, None])
                t = p.sum(axis=1)
                ll += float((np.log(t) + top).sum())
                seen += len(z)
                p /= t[:, None]
                n += p.sum(axis=0)
                x += p.T @ z
                xx += p.T @ (z * z)
            yield pd.DataFrame({"sums": [[*n, *x.ravel(), *xx.ravel(), ll, float(seen)]]})

        parts = packed.mapInPandas(sums, "sums array<double>")
        got = parts.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(k + 2 * k * d + 2)
        for r in got:
            v[r.i] = r.v
        n, x, xx = v[:k], v[k : k + k * d].reshape(k, d), v[k + k * d : k + 2 * k * d].reshape(k, d)
        score = v[-2] / max(v[-1], 1)
        if abs(score - last) < tolerance or not v[-1]:
            m.rounds, m.converged = done, True
            return m
        last = score
        held = (n > 1e-6)[:, None]
        share = np.maximum(n, 1e-9)[:, None]
        centres = np.where(held, x / share, m.centres)
        spreads = np.where(held, np.clip(xx / share - centres**2, least_spread, most_spread), m.spreads)
        m = Mixture(mean, scale, np.maximum(n, 1e-9) / np.maximum(n, 1e-9).sum(), centres, spreads, done)
    warnings.warn(f"the mixture has not settled in {rounds} rounds", RuntimeWarning, stacklevel=2)
    return m


def name_components(m: Mixture, kinds: list[str], examples: list[np.ndarray]) -> list[str]:
    """The kind of each component: that of the examples it is most responsible for, the kinds weighing alike."""
    votes = np.zeros((len(m.weights), len(KINDS)))
    for kind, e in zip(kinds, examples):
        votes[:, KINDS.index(kind)] += m.posterior(m.standard(e)).sum(axis=0) / len(e)
    return [KINDS[i] for i in votes.argmax(axis=1)]


def classify(docs: DataFrame, common: DataFrame, share: float = 0.5) -> DataFrame:
    """(id, n_chars, prose, list, table, junk, found): characters by kind, and whether more than `share` of them is no prose.

    docs: id, text; other columns are ignored. Null, empty and blank texts have no row. Documents repeated under
    one id count together. Every block of every text is read whole.
    """
    units = cut(block_stats(docs, common), "blocks")
    words = _common_words(common)
    groups = [measure(list(ts), words, False)[list(STATS)].to_numpy(float) for _, ts in EXAMPLES]
    m = fit(units, groups)
    names = name_components(m, [k for k, _ in EXAMPLES], groups)
    cols = list(STATS)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = m.posterior(m.standard(b[cols].to_numpy(float))) if len(b) else np.zeros((0, len(names)))
            by = np.stack([p[:, [j for j, n in enumerate(names) if n == k]].sum(axis=1) for k in KINDS], axis=1)
            yield pd.DataFrame({"id": b["id"], "no": b["no"], "n_chars": b["n_chars"], "kind": [KINDS[i] for i in by.argmax(axis=1)]})

    kind = dict(docs.dtypes)["id"]
    labelled = units.mapInPandas(label, f"id {kind}, no int, n_chars bigint, kind string")
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n_chars")).otherwise(0)).alias(k) for k in KINDS]
    out = labelled.groupBy("id").agg(F.sum("n_chars").alias("n_chars"), *sums)
    return out.withColumn("found", F.col("n_chars") - F.col("prose") > share * F.col("n_chars"))
