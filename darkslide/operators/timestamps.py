"""Mixed timestamp notations to one UTC reading per value.

Every notation is a component of a mixture. A value may be readable in several ways (seconds or milliseconds,
day first or month first); each reading is a candidate with an instant. Per source, expectation-maximisation
estimates how often each notation is used, from all values at once: a value gives each of its candidates its
posterior share, and the shares give the next weights. Posteriors then choose the reading, and a value whose
best reading does not clearly win is marked ambiguous instead of being guessed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.functions.lets import let
from darkslide.session import cut

# Zone names in texts, in minutes east of UTC.
ZONE_MINUTES = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "IST": 330,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_ZONE = r"(?:\s*(Z|[A-Z]{2,5}(?:[+\-−]\d{1,2}(?::?\d{2})?)?|[+\-−]\d{1,2}(?::?\d{2})?))?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:[\s  ]*([AaPp])\.?[Mm]\.?)?"
# each pattern with the group numbers of year, month, day; the clock and zone groups follow at the number given last
PATTERNS = {
    "ymd": (rf"^(\d{{4}})[-:/.](\d{{1,2}})[-:/.](\d{{1,2}})(?:[Tt ,]+){_CLOCK}{_ZONE}$", 1, 2, 3, 4),
    "dmy": (rf"^(\d{{1,2}})[-:/.](\d{{1,2}})[-:/.](\d{{4}})(?:[Tt ,]+){_CLOCK}{_ZONE}$", 3, 2, 1, 4),
    "mdy": (rf"^(\d{{1,2}})[-:/.](\d{{1,2}})[-:/.](\d{{4}})(?:[Tt ,]+){_CLOCK}{_ZONE}$", 3, 1, 2, 4),
    "english": (rf"^(?:[A-Za-z]{{3,9}},? )?([A-Za-z]{{3}})[a-z]* (\d{{1,2}}),? (\d{{4}}),? {_CLOCK}{_ZONE}$", 3, 1, 2, 4),
    "mail": (rf"^(?:[A-Za-z]{{3,9}},? )?(\d{{1,2}})[ -]([A-Za-z]{{3}})[a-z]*[ -](\d{{4}}),? {_CLOCK}{_ZONE}$", 3, 2, 1, 4),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt _-]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?()?{_ZONE}$", 1, 2, 3, 4),
}
UNITS = {"epoch_s": 1_000_000, "epoch_ms": 1_000, "epoch_us": 1, "epoch_ns": 0.001}
LEAST = {"epoch_s": 0.0, "epoch_ms": 1e9, "epoch_us": 1e12, "epoch_ns": 1e15}  # smaller numbers would name days at the epoch itself
FORMATS = (*PATTERNS, *UNITS)
_NUMBER = r"^[+-]?\d+(\.\d*)?([eE][+-]?\d+)?$"
_JUNK = "[\\x00-\\x20\\u00a0\\u2007\\u202f\\ufeff]+"

DAY_US = 86_400_000_000


def parse_offset(text: F.Column, limit_s: int = 14 * 3600) -> F.Column:
    """Seconds east of UTC of an offset such as +05:30, +0530, +5, UTC+05:30, Z or a zone name; null if it is none or beyond limit_s."""
    named = F.create_map(*(F.lit(v) for k, m in ZONE_MINUTES.items() for v in (k, m * 60))).cast("map<string,bigint>")

    def digits(p: F.Column) -> F.Column:
        # "+5" and "+05" are hours, "+530" and "+0530" end in minutes
        d = F.regexp_replace(F.substring(p, 2, 9), ":", "")
        return let(F.when(F.length(d) > 2, F.lpad(d, 4, "0")).otherwise(F.rpad(F.lpad(d, 2, "0"), 4, "0")), lambda d: seconds(p, d))

    def seconds(p: F.Column, d: F.Column) -> F.Column:
        minutes = F.substring(d, 3, 2).try_cast("long")
        s = F.substring(d, 1, 2).try_cast("long") * 3600 + minutes * 60
        return F.when((minutes < 60) & (s <= limit_s), F.when(F.startswith(p, F.lit("-")), -s).otherwise(s))

    clean = F.upper(F.translate(F.regexp_replace(F.regexp_replace(text, f"^{_JUNK}", ""), f"{_JUNK}$", ""), "−–", "--"))
    own = lambda t: let(F.regexp_extract(t, r"^(?:UTC|GMT)?([+-]\d{1,2}(?::?\d{2})?)$", 1), lambda p: F.when(p != "", digits(p)))
    return F.when(text.isNotNull() & (text != ""), let(clean, lambda t: F.coalesce(F.try_element_at(named, t), own(t))))


def _text_reading(clean: F.Column, fmt: str) -> F.Column:
    pattern, y, m, d, c = PATTERNS[fmt]
    groups = F.split(F.regexp_replace(clean, pattern, "|".join(f"${i}" for i in range(1, c + 6))), r"\|")

    def read(groups: F.Column) -> F.Column:
        g = lambda i: F.get(groups, F.lit(i - 1))
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(g(m))).cast("int") if fmt in ("english", "mail") else g(m).try_cast("int")
        hour, half = g(c).try_cast("int"), F.lower(g(c + 4))
        hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        second = F.coalesce(F.nullif(g(c + 2), F.lit("")), F.lit("0")).try_cast("int")
        micros = F.rpad(F.substring(F.coalesce(g(c + 3), F.lit("")), 1, 6), 6, "0").try_cast("long")
        stamp = F.try_make_timestamp_ntz(g(y).try_cast("int"), month, g(d).try_cast("int"), hour, g(c + 1).try_cast("int"), F.when(second < 60, second).cast("decimal(16,6)"))
        wall = F.unix_micros(F.to_utc_timestamp(stamp.cast("timestamp"), "UTC")) + micros
        zone = g(c + 5)
        reading = lambda o: F.struct(F.lit(fmt).alias("fmt"), wall.alias("wall_us"), o.alias("offset_s"))
        # an unknown zone name leaves the value without a reading; an offset out of range counts as not written
        return let(parse_offset(zone), lambda o: F.when((zone == "") | o.isNotNull() | F.rlike(zone, F.lit("^[+\\-−]")), reading(o)))

    return F.when(F.rlike(clean, F.lit(pattern)), let(groups, read))


def candidates(text: F.Column, low_year: int = 1800, high_year: int = 2100) -> F.Column:
    """All readings of a text: array of (fmt, wall_us, offset_s), empty where it has none.

    wall_us is the written clock as if it were UTC; offset_s is null where no zone is written. Numbers count
    from the epoch, in each unit that puts them between the two years; zero is no time. Impossible dates
    (30 February), hours past 23 and seconds past 59 are no reading; missing fields of the time are zero.
    """
    low, high = (int((np.datetime64(f"{y}-01-01") - np.datetime64("1970-01-01")).astype(int)) * DAY_US for y in (low_year, high_year))

    def units(number: F.Column) -> F.Column:
        def one(fmt: str, scale: float) -> F.Column:
            us = F.when((F.abs(number) < F.lit(10.0) ** 20) & (F.abs(number) >= LEAST[fmt]) & (number != 0), number * F.lit(scale).cast("decimal(11,3)"))
            return let(us, lambda us: F.when(us.between(low, high), F.struct(F.lit(fmt).alias("fmt"), us.try_cast("long").alias("wall_us"), F.lit(0).cast("long").alias("offset_s"))))

        return F.array(*(one(*u) for u in UNITS.items()))

    def read(clean: F.Column) -> F.Column:
        number = F.coalesce(F.when(F.length(clean) <= 28, clean.try_cast("decimal(38,9)")), clean.try_cast("double").try_cast("decimal(38,9)"))
        # most values are numbers, so their pattern is tried first; a run of 14 digits may be either
        texts = F.array(*(_text_reading(clean, f) for f in PATTERNS))
        plain = F.rlike(clean, F.lit(_NUMBER))
        return F.when(plain, F.concat(F.array(_text_reading(clean, "compact")), let(number, units))).otherwise(texts)

    clean = F.regexp_replace(F.regexp_replace(text, f"^{_JUNK}", ""), f"{_JUNK}$", "")
    found = F.filter(let(clean, read), lambda c: c.isNotNull() & c["wall_us"].isNotNull())
    return F.coalesce(found, F.array().cast("array<struct<fmt:string,wall_us:bigint,offset_s:bigint>>"))


def _density(band: str) -> float:
    """Chance of one day under the prior over capture times, by its band."""
    return {"now": 0.95 / 35, "past": 0.045 / 190, "off": 0.005 / 75}[band]


def _em(profiles: list[tuple[list[tuple[str, str]], int]], prior: float, rounds: int, tolerance: float) -> dict[str, float]:
    """Weights of the notations of one source from its profiles (candidates with their bands) and counts."""
    fmts = sorted({f for p, _ in profiles for f, _ in p})
    at = {f: i for i, f in enumerate(fmts)}
    like = np.zeros((len(profiles), len(fmts)))
    for i, (p, _) in enumerate(profiles):
        for f, band in p:
            like[i, at[f]] = _density(band)
    n = np.array([c for _, c in profiles], float)
    w = np.full(len(fmts), 1 / len(fmts))
    for _ in range(rounds):
        post = like * w
        post /= post.sum(axis=1, keepdims=True)
        new = (post * n[:, None]).sum(axis=0) + prior
        new /= new.sum()
        moved, w = np.abs(new - w).max(), new
        if moved < tolerance:
            break
    return dict(zip(fmts, w.tolist()))


def resolve(df: DataFrame, text: str, source: str, now_year: int = 2026, confidence: float = 0.95, rounds: int = 200, broadcast_sources: int = 100_000) -> DataFrame:
    """df with one column more, `reading`: (fmt, wall_us, offset_s, posterior, ambiguous), null where the text has no reading.

    source names the column whose values have their own mixtures; null is a source too. The estimate reads
    only counts of (source, set of possible notations), so what one task gets of a source is bounded by the
    number of such sets, however many rows the source has. Empty tables give an empty result.
    """
    bounds = [int((np.datetime64(f"{y}-01-01") - np.datetime64("1970-01-01")).astype(int)) * DAY_US for y in (1800, 1990, now_year + 1)]
    band = lambda c: F.when(c["wall_us"] >= bounds[2], "off").when(c["wall_us"] >= bounds[1], "now").when(c["wall_us"] >= bounds[0], "past").otherwise("off")
    df = df.withColumn("_c", F.transform(candidates(F.col(text)), lambda c: F.struct(c["fmt"].alias("fmt"), c["wall_us"].alias("wall_us"), c["offset_s"].alias("offset_s"), band(c).alias("band"))))
    # the counts are written once, as the weights are asked for their number and then joined
    seen = cut(
        df.where(F.size("_c") > 0)
        .groupBy(F.col(source).cast("string").alias("_source"), F.transform("_c", lambda c: F.struct(c["fmt"].alias("f"), c["band"].alias("b"))).alias("profile"))
        .count(),
        "profiles",
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _em([([(c["f"], c["b"]) for c in p], int(n)) for p, n in zip(pdf["profile"], pdf["count"])], 0.01, rounds, 1e-9)
        return pd.DataFrame({"_source": [pdf["_source"].iloc[0]], "weights": [list(w.items())]})

    weights = (
        seen.groupBy("_source").applyInPandas(lambda p: fit(p).assign(weights=lambda d: [[{"f": f, "w": w} for f, w in x] for x in d["weights"]]), "_source string, weights array<struct<f:string,w:double>>")
        .select("_source", F.map_from_entries("weights").alias("_w"))
    )
    if weights.limit(broadcast_sources + 1).count() <= broadcast_sources:
        weights = F.broadcast(weights)
    scored = df.join(weights, F.col(source).cast("string").eqNullSafe(F.col("_source")), "left")
    density = lambda c: reduce(lambda w, b: w.when(c["band"] == b, _density(b)), ("now", "past", "off"), F.when(F.lit(False), 0.0))
    shares = F.transform("_c", lambda c: F.struct((F.coalesce(F.try_element_at("_w", c["fmt"]), F.lit(0.0)) * density(c)).alias("p"), c["fmt"].alias("fmt"), c["wall_us"].alias("wall_us"), c["offset_s"].alias("offset_s")))

    def choose(c: F.Column, best: F.Column) -> F.Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x["p"])
        # readings that name the same instant agree, whatever their notation
        same = F.aggregate(c, F.lit(0.0), lambda a, x: a + F.when(x["wall_us"] == best["wall_us"], x["p"]).otherwise(0.0))
        return let(same / F.nullif(total, F.lit(0.0)), lambda p: F.struct(best["fmt"].alias("fmt"), best["wall_us"].alias("wall_us"), best["offset_s"].alias("offset_s"), p.alias("posterior"), (p < confidence).alias("ambiguous")))

    reading = let(shares, lambda c: let(F.array_max(c), lambda best: choose(c, best)))
    return scored.withColumn("reading", F.when(F.size("_c") > 0, reading)).drop("_c", "_w", "_source")


def zone_offset_s(zone: F.Column, utc_s: F.Column) -> F.Column:
    """Offset of a zone at an instant, with the zone's history."""
    t = F.timestamp_seconds(utc_s)
    return (F.unix_timestamp(F.from_utc_timestamp(t, zone)) - F.unix_timestamp(t)).cast("long")


def known_zone(spark, zone: F.Column) -> F.Column:
    """The zone, or null where the runtime does not know its name (a name would else raise)."""
    names = [str(x) for x in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()]
    return F.when(F.trim(zone).isin(*sorted(names)), F.trim(zone))


def zone_readings(zone: F.Column, wall_us: F.Column) -> F.Column:
    """The instants (microseconds) at which a clock in the zone shows wall_us: one, two around a clock set back, none in a gap."""

    def read(wall_s: F.Column) -> F.Column:
        offs = F.array_distinct(F.array(zone_offset_s(zone, wall_s - 86_400), zone_offset_s(zone, wall_s + 86_400)))
        return F.filter(offs, lambda o: zone_offset_s(zone, wall_s - o) == o)

    return F.transform(let(F.floor(wall_us / 1_000_000).cast("long"), read), lambda o: wall_us - o * 1_000_000)


def camera_readings(wall_us: F.Column, own_offset: F.Column, offset_text: F.Column, zone: F.Column, group_offset: F.Column) -> F.Column:
    """(rule, instants) of a camera clock; the first usable rule decides.

    dto-offset: an offset in the value itself. offset-tag: the separate offset tag. zone: the camera's zone,
    with none, one or two instants. group-offset: the offset known for the group. open: no zone is known and
    instants is null. zone must be a known name or null.
    """
    one = lambda o: F.array(wall_us - o * 1_000_000)
    make = lambda rule, xs: F.struct(F.lit(rule).alias("rule"), xs.alias("instants"))
    return let(
        parse_offset(offset_text),
        lambda tag: F.when(own_offset.isNotNull(), make("dto-offset", one(own_offset)))
        .when(tag.isNotNull(), make("offset-tag", one(tag)))
        .when(zone.isNotNull(), make("zone", zone_readings(zone, wall_us)))
        .when(group_offset.isNotNull(), make("group-offset", one(group_offset)))
        .otherwise(make("open", F.lit(None).cast("array<bigint>"))),
    )


def clocks_disagree(instants: F.Column, wall_us: F.Column, other_us: F.Column, slack_us: int = 60_000_000, quarter_us: int = 900_000_000, span_us: int = 14 * 3_600_000_000) -> F.Column:
    """True where no permitted reading is within slack of other_us; open readings may take any whole quarter hour up to 14 hours either way."""
    d = wall_us - other_us
    k = F.greatest(F.lit(-(span_us // quarter_us)), F.least(F.lit(span_us // quarter_us), F.round(d / quarter_us))).cast("long")
    return F.when(instants.isNull(), F.abs(d - k * quarter_us) > slack_us).otherwise(~F.exists(instants, lambda t: F.abs(t - other_us) <= slack_us))
