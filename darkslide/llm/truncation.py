"""Text values that lost their end: significant lengths, incomplete endings, and how often each source cuts.

A field with a limit shows in its lengths. Among the values of a source that reach a length, the share that
stop there is the hazard of that length; each hazard is tested against the hazards of the lengths around it,
with the false-discovery rate held over all tests. At a significant length the excess over the neighbours is
the chance that a value was cut there. Transfers that break off stop anywhere: their share is a weight of a
mixture, told by the endings of a source's values. One posterior weighs limit, broken transfer and natural end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkslide.session import cut

# Extensions that close a file name, and the tail that the export puts on sidecar names.
EXTENSIONS = ("jpg", "jpeg", "heic", "heif", "png", "gif", "webp", "mp4", "m4v", "mov", "mp", "mv", "3gp", "3g2", "dng", "cr2", "cr3", "nef", "arw", "orf", "raf", "rw2", "tif", "tiff", "bmp", "avi", "mkv", "webm", "mpg", "mpeg", "wmv", "mts")
TAIL = "supplemental-metadata"
WHOLE_NAMES = ("metadata", "shared_album_comments", "user-generated-memory-titles", "print-subscriptions", "thumbs.db", "desktop.ini")

_EXT = r"(?i)\.(?:" + "|".join(sorted(EXTENSIONS, key=lambda e: (-len(e), e))) + r")"
_NUMBER = r"(?:\(\d+\))?"
_SPACE = r"\p{Z}\s"
_NO_SPACES = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\u30fc\p{IsThai}"
_MARK = "(?:\\.{2,3}|\\u2026|\\ufffd|~\\d*)$"


def _prefixes(word: str) -> list[str]:
    return [word[:i] for i in range(len(word))]


def shape(text: F.Column, sidecar_name: F.Column) -> F.Column:
    """How a value ends: 'ext' with a whole extension, 'part' with a part of one, 'mark' with a sign of a cut, 'bare' with neither, 'fixed' for names that are whole as they are.

    sidecar_name: true for the name of a sidecar without its `.json`, which may carry a tail after the extension.
    """
    low = F.lower(text)
    part = [p for e in EXTENSIONS for p in _prefixes(e)]
    part_ext = r"(?i)\.(?:" + "|".join(sorted({p for p in part}, key=lambda e: (-len(e), e))) + r")$"
    part_tail = r"\.(?:" + "|".join(sorted(_prefixes(TAIL), key=lambda e: -len(e))) + r")$"
    whole = F.rlike(text, F.lit(_EXT + _NUMBER + "$"))
    tail = F.rlike(text, F.lit(_EXT + _NUMBER + r"\." + TAIL + _NUMBER + "$")) | F.rlike(text, F.lit(r"\." + TAIL + _NUMBER + "$"))
    return (
        F.when(low.isin(*WHOLE_NAMES) | F.startswith(text, F.lit(".")), "fixed")
        .when(whole | (sidecar_name & tail), "ext")
        .when(F.rlike(text, F.lit(_MARK)), "mark")
        .when(F.rlike(text, F.lit(part_ext)) | (sidecar_name & F.rlike(text, F.lit(part_tail))), "part")
        .otherwise("bare")
    )


def ending(text: F.Column) -> F.Column:
    """The last word of a value without extension, number and mark, digits written as 0; a value that ends in a space has the empty word. Scripts written without spaces have their last two characters as a word."""
    stem = F.regexp_replace(text, f"{_EXT}{_NUMBER}(?:\\.{TAIL})?{_NUMBER}$|{_NUMBER}$|{_MARK}", "")
    return F.translate(F.regexp_extract(stem, f"([{_NO_SPACES}]{{1,2}}|[^{_SPACE}{_NO_SPACES}]*)$", 1), "123456789", "000000000")


def inner_words(text: F.Column) -> F.Column:
    """The words of a value before its last space, digits written as 0."""
    head = F.regexp_extract(text, f"^(.*)[{_SPACE}]", 1)
    return F.filter(F.split(F.translate(head, "123456789", "000000000"), f"[{_SPACE}]+"), lambda w: w != "")


def length_tests(values: DataFrame, by: list[str], reach: int = 5, grid: float = 0.01) -> DataFrame:
    """(by..., unit, length, n, excess, q): every length at which values of a group stop, tested against the lengths around it.

    values: the columns named in by, with chars and bytes. The hazard of a length is n(length) / n(at least
    length). Its neighbours are the lengths within reach on either side; the median of their hazards is what is
    expected. The p-value is the Chernoff bound of the binomial tail. q is the least false-discovery rate at which
    the step-up rule over all tests accepts the length. excess is the share of the values at the length beyond the
    expected, 0 where there are none.

    Windows see one row per group and length. The one ranking over all groups sees p-values rounded up to a grid of
    logarithms, so its lines are bounded (70,000) however many groups there are.
    """
    counted = values.groupBy(*by, "chars", "bytes").agg(F.count("*").alias("n"))
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    counted = counted.select(*by, "n", units.alias("u")).groupBy(*by, F.col("u.unit").alias("unit"), F.col("u.length").alias("length")).agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*by, "unit").orderBy("length")
    down = Window.partitionBy(*by, "unit").orderBy(F.desc("length"))
    t = counted.withColumn("least", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("h", F.col("n") / F.col("least"))
    below, above = order.rangeBetween(-reach, -1), order.rangeBetween(1, reach)
    # absent lengths below count as hazard 0; above, a length says something only while enough values reach it
    gaps = F.transform(F.filter(F.sequence(F.lit(1), F.lit(reach)), lambda i: i > F.size(F.collect_list("h").over(below))), lambda i: F.lit(0.0))
    near = F.array_sort(F.concat(gaps, F.collect_list("h").over(below), F.collect_list(F.when(F.col("least") >= 20, F.col("h"))).over(above)))
    t = t.withColumn("near", near).withColumn("above", F.collect_list(F.when(F.col("least") >= 20, F.col("h"))).over(above))
    expected = (F.get("near", F.floor((F.size("near") - 1) / 2).cast("int")) + F.get("near", F.floor(F.size("near") / 2).cast("int"))) / 2
    t = t.withColumn("expected", F.greatest(expected, F.lit(0.5) / F.col("least")))
    # the shortest values have nothing below to compare with: where most go on, at least what is usual above is expected
    onward = F.coalesce(F.sum("n").over(order.rangeBetween(reach + 1, Window.unboundedFollowing)), F.lit(0))
    first = (F.size(F.collect_list("h").over(order.rangeBetween(Window.unboundedPreceding, -1))) == 0) & (2 * onward >= F.col("least"))
    t = t.withColumn("expected", F.when(first, F.greatest("expected", F.array_min("above"))).otherwise(F.col("expected")))
    h, e = F.least(F.col("h"), F.lit(1 - 1e-12)), F.least(F.col("expected"), F.lit(1 - 1e-9))
    log_p = -F.col("least") * (h * F.log(h / e) + (1 - h) * F.log((1 - h) / (1 - e)))
    more = F.col("h") > F.col("expected")
    t = t.withColumn("bin", F.ceil(F.greatest(F.when(more, log_p).otherwise(0.0), F.lit(-700.0)) / grid).cast("int"))
    t = cut(t.select(*by, "unit", "length", "n", "bin", F.when(more, 1 - F.col("expected") / F.col("h")).otherwise(0.0).alias("excess")), "lengths")
    bins = t.groupBy("bin").agg(F.count("*").alias("k"))
    rank = F.sum("k").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumn("log_q", F.col("bin") * grid + F.log(F.sum("k").over(Window.partitionBy()) / rank))
    q = F.exp(F.least(F.lit(0.0), F.min("log_q").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))))
    return t.join(F.broadcast(bins.select("bin", q.alias("q"))), "bin").drop("bin")


def hazards(values: DataFrame, by: list[str], reach: int = 5, rate: float = 0.001) -> DataFrame:
    """(by..., unit, length, n, excess, q) of the lengths at which values of a group stop too often to be chance, with the false discoveries among all tests held at rate."""
    return length_tests(values, by, reach).where(F.col("q") <= rate)


# Chances of an ending, by (state, whether the last word ends whole values): of values that were cut, and of whole
# ones of each field. A file name as such has an extension; a title may lack it.
_IF_CUT = {("ext", True): 0.02, ("ext", False): 0.08, ("bare", True): 0.15, ("bare", False): 0.45, ("part", True): 0.1, ("part", False): 0.1, ("mark", True): 0.04, ("mark", False): 0.06}
_IF_WHOLE = {
    "name": {("ext", True): 0.97, ("ext", False): 0.03, ("bare", True): 1e-6, ("bare", False): 1e-6, ("part", True): 1e-6, ("part", False): 1e-6, ("mark", True): 1e-6, ("mark", False): 1e-6},
    "title": {("ext", True): 0.96, ("ext", False): 0.03, ("bare", True): 0.01, ("bare", False): 2e-5, ("part", True): 1e-6, ("part", False): 1e-6, ("mark", True): 5e-4, ("mark", False): 2e-5},
}
# chance of a whole last word of a whole value, and the least of a value cut at a limit
_WORD_IF_WHOLE, _LEAST_WORD = 0.98, 0.02
_NO_SOURCE = "\u0000"


def _by_class(table: dict[tuple[str, bool], float], state: F.Column, whole: F.Column) -> F.Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for (s, w), p in table.items():
        out = out.when((state == s) & (whole == F.lit(w)), p)
    return out


def _chances(field: F.Column, state: F.Column, whole: F.Column) -> tuple[F.Column, F.Column]:
    """(chance of the ending of a cut value, of a whole one); fields but `title` are those of file names."""
    uncut = F.when(field == "title", _by_class(_IF_WHOLE["title"], state, whole)).otherwise(_by_class(_IF_WHOLE["name"], state, whole))
    return _by_class(_IF_CUT, state, whole), uncut


def broken_transfers(classes: DataFrame, rounds: int = 100) -> DataFrame:
    """(field, source, background): the share of values that were cut at no limit, as transfers that break off anywhere leave them.

    classes: field, source, state, whole, n: how many values away from limits have each ending. The share is the
    weight of a two-part mixture with known chances of endings, by expectation-maximisation from 1 %; its likelihood
    has one maximum. A source is one line of at most eight numbers.
    """
    l1, l0 = _chances(F.col("field"), F.col("state"), F.col("whole"))
    each = classes.groupBy("field", "source").agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), l1.alias("l1"), l0.alias("l0"))).alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["n"])
    step = lambda b, _: F.aggregate("c", F.lit(0.0), lambda a, x: a + x["n"] * b * x["l1"] / (b * x["l1"] + (1 - b) * x["l0"])) / total
    return each.select("field", "source", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.01), step).alias("background"))


def judge(values: DataFrame, rate: float = 0.001, least_share: float = 0.05, least_broken: float = 0.3, broadcast_rows: int = 100_000) -> DataFrame:
    """(rec_id, field, source, unit, length, q, excess, background, posterior, evidence, is_cut) of every value that may be cut.

    values: rec_id, field, source, text, sidecar_name (boolean), sibling: a longer form of the same text where
    there is one, else null. Other columns are ignored. Null and empty texts are never cut; a null source is a
    source of its own, to which the limits of named sources apply too. Values with a whole extension at no limit
    have no line.

    A value stopped at its length for one of three reasons: the limit there, with the chance `excess` of a
    significant length (0 elsewhere); a transfer that broke off, which the source's `background` tells from the
    endings of its values away from limits; or its end. The posterior weighs them by the ending: whether it has an
    extension, whole or in part, or a mark, and whether its last word is one with which whole values end. A length
    counts as a limit only if at least least_broken of the values there end in other words. q is that of the
    length's test in the unit that tells more. The exact check follows: a sibling that goes on (`on`) or stops there
    too (`whole`) overrules the posterior.
    """
    text, sib = F.col("text"), F.col("sibling")
    kept = values.select("rec_id", "field", F.coalesce(F.col("source"), F.lit(_NO_SOURCE)).alias("source"), "text", "sidecar_name", "sibling")
    state = F.when(text.isNotNull() & (text != ""), shape(text, F.col("sidecar_name")))
    after = F.when(F.startswith(sib, text), F.substring(sib, F.length(text) + 1, F.lit(1_000_000_000)))
    goes_on = (after != "") & ~F.rlike(after, F.lit(r"^(?:\(\d+\))?(?:\.|$)"))
    ends_there = F.rlike(after, F.lit(_EXT.replace("(?i)", "(?i)^" + _NUMBER)))
    base = kept.select(
        "rec_id", "field", "source", state.alias("state"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), ending(text).alias("word"),
        F.when(goes_on, "on").when(ends_there, "whole").alias("evidence"), "sidecar_name",
    )
    base = cut(base, "endings")
    by = ["field", "source", "state"]
    # names that end in a number have few lengths by nature, and a sidecar's name that ends in an extension has lost nothing
    exempt = (F.col("state") == "ext") & (F.contains(F.col("word"), F.lit("0")) | F.col("sidecar_name"))
    tests = length_tests(base.where((F.col("state") != "fixed") & ~exempt), by)
    # values without source come from any uploader: a limit of a named source of the same field holds for them too,
    # even where too few reach it to show it by themselves
    same = ["field", "state", "unit", "length"]
    known = F.col("q") <= rate
    named = tests.where(known & (F.col("source") != _NO_SOURCE)).select(*same).distinct().withColumn("inherited", F.lit(True))
    tests = tests.join(named, same, "left").withColumn("known", known)
    at_limit = F.col("known") | ((F.col("source") == _NO_SOURCE) & F.coalesce("inherited", F.lit(False)))
    tests = cut(tests.select(*by, "unit", "length", "q", "known", F.when(at_limit, F.nullif("excess", F.lit(0.0))).alias("x")), "tests")
    few = tests.limit(broadcast_rows + 1).count() <= broadcast_rows
    hint = F.broadcast if few else (lambda d: d)
    side = lambda unit: hint(tests.where(F.col("unit") == unit).select(*by, F.col("length").alias(unit), F.col("x").alias(f"x_{unit}"), F.col("q").alias(f"q_{unit}")))
    judged = base.where("state is not null").join(side("chars"), [*by, "chars"], "left").join(side("bytes"), [*by, "bytes"], "left")
    zero = F.lit(0.0)
    x_chars, x_bytes = F.coalesce("x_chars", zero), F.coalesce("x_bytes", zero)
    judged = judged.withColumn("excess", F.when(exempt, 0.0).otherwise(F.greatest(x_chars, x_bytes)))
    told = F.when(F.col("excess") > 0, x_chars >= x_bytes).otherwise(F.coalesce("q_chars", F.lit(1.0)) <= F.coalesce("q_bytes", F.lit(1.0)))
    judged = judged.withColumn("unit", F.when(told, "chars").otherwise("bytes")).withColumn("length", F.when(told, F.col("chars")).otherwise(F.col("bytes")))
    judged = judged.withColumn("q", F.coalesce(F.when(told, F.col("q_chars")).otherwise(F.col("q_bytes")), F.lit(1.0)))
    at = F.when(F.col("excess") > 0, 1).otherwise(0)
    spot = [F.when(F.col("excess") > 0, F.col(c)).alias(c) for c in ("unit", "length")]
    counts = cut(judged.groupBy("word", *by, *spot).agg(F.count("*").alias("n"), F.sum(at).alias("at")), "ends")
    # a word ends whole values if a share of all its occurrences does so; a count would grow with the corpus
    inside = kept.where("text <> ''").select(F.explode(inner_words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("inside"))
    words = cut(counts.groupBy("word").agg(F.sum("n").alias("last")).join(inside, "word", "left").select("word", (F.col("last") + F.coalesce("inside", F.lit(0))).alias("all")), "words")
    # where names just happen to have one length, the words there end values of other lengths as well; a limit breaks many of them
    ext = F.col("state") == "ext"
    spots = counts.groupBy("word").agg(F.sum(F.when(ext, F.col("n")).otherwise(0)).alias("ends")).join(words, "word")
    own = counts.where(ext & (F.col("at") > 0)).groupBy("word", "unit", "length").agg(F.sum("n").alias("own"))
    broken = counts.where("at > 0").join(spots, "word").join(own, ["word", "unit", "length"], "left")
    elsewhere = F.col("ends") - F.coalesce("own", F.lit(0))
    fragment = (F.col("word") == "") | (elsewhere < least_share * F.col("all")) | (elsewhere == 0)
    broken = broken.groupBy(*by, "unit", "length").agg((F.sum(F.when(fragment, F.col("at")).otherwise(0)) / F.sum("at")).alias("broken"))
    broken = cut(broken.where(F.col("broken") >= least_broken).join(tests.select(*by, "unit", "length", "known"), [*by, "unit", "length"]), "limits")
    confirmed = broken.where(F.col("known") & (F.col("source") != _NO_SOURCE)).select(*same).distinct().withColumn("inherited", F.lit(True))
    limits = hint(broken.join(confirmed, same, "left").where("known or inherited").select(*by, "unit", "length", "broken"))
    away = counts.join(limits, [*by, "unit", "length"], "left_anti")
    ends = away.where(ext).groupBy("word").agg(F.sum("n").alias("ends"))
    ends = cut(ends.join(words, "word").where(F.col("ends") >= least_share * F.col("all")).select("word", "ends"), "whole-words")
    whole = F.col("ends").isNotNull() & (F.col("word") != "")
    classes = away.where("state <> 'fixed'").join(ends, "word", "left").groupBy(*by, whole.alias("whole")).agg(F.sum("n").alias("n"))
    background = broken_transfers(classes)
    # few values are asked about, and the words they end in are counted before they are joined
    asked = judged.where("state in ('bare', 'part', 'mark') or excess > 0").join(ends, "word", "left").withColumn("whole", whole)
    asked = asked.join(limits, [*by, "unit", "length"], "left").join(hint(background), ["field", "source"], "left")
    x, b = F.when(F.col("broken").isNotNull(), F.col("excess")).otherwise(0.0), F.coalesce("background", zero)
    l1, l0 = _chances(F.col("field"), F.col("state"), F.col("whole"))
    o1, o0 = _chances(F.col("field"), F.col("state"), ~F.col("whole"))
    asked = asked.withColumns({"excess": x, "_mine": b * l1 + (1 - b) * l0, "_other": b * o1 + (1 - b) * o0, "_cut": b * l1})
    word = lambda p: F.when(F.col("whole"), p).otherwise(1 - p)
    # what is not due to the limit ends as values elsewhere do; what is, as the words broken there tell
    rest = F.when(ext, word(F.lit(_WORD_IF_WHOLE))).otherwise(F.col("_mine") / (F.col("_mine") + F.col("_other"))) * (1 - F.col("excess"))
    intact = (1 - F.col("broken") - (1 - F.col("excess")) * _WORD_IF_WHOLE) / F.col("excess")
    limit = F.when(F.col("excess") > 0, F.col("excess") * word(F.greatest(F.lit(_LEAST_WORD), F.least(intact, F.lit(1 - _LEAST_WORD))))).otherwise(0.0)
    asked = asked.withColumn("posterior", (limit + rest * F.col("_cut") / F.col("_mine")) / (limit + rest))
    is_cut = F.when(F.col("evidence") == "whole", False).when(F.col("evidence") == "on", True).otherwise(F.col("posterior") > 0.5)
    return asked.select("rec_id", "field", F.nullif("source", F.lit(_NO_SOURCE)).alias("source"), "unit", "length", "q", "excess", "background", "posterior", "evidence", is_cut.alias("is_cut"))


def find(values: DataFrame, **options) -> DataFrame:
    """(rec_id, field, source, unit, length, q, excess, background, posterior, evidence) of the values that are cut; see judge."""
    return judge(values, **options).where("is_cut").drop("is_cut")


def totals(values: DataFrame) -> DataFrame:
    """(field, source, total): values that are neither null nor empty, by source."""
    return values.where("text <> ''").groupBy("field", "source").agg(F.count("*").alias("total"))


def shares(values: DataFrame, found: DataFrame) -> DataFrame:
    """(field, source, total, cut, share) of each source; a source without cut values has share 0."""
    cuts = found.groupBy("field", "source").agg(F.count("*").alias("cut"))
    t, c = totals(values).alias("t"), cuts.alias("c")
    same = reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("field", "source")))
    n = F.coalesce("c.cut", F.lit(0))
    return t.join(c, same, "left").select("t.field", "t.source", "total", n.alias("cut"), (n / F.col("total")).alias("share"))
