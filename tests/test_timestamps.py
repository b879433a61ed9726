from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from darkslide.operators import timestamps as ts


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("1458246582", us(2016, 3, 17, 20, 29, 42)),
    ("1610509014600", us(2021, 1, 13, 3, 36, 54, micro=600_000)),
    ("1389608154222052", us(2014, 1, 13, 10, 15, 54, micro=222_052)),
    ("1.669706606E9", us(2022, 11, 29, 7, 23, 26)),
    ("-586601053", -586_601_053_000_000),
    ("-7971213000", -7_971_213_000_000),
    ("2024-07-11T23:26:22Z", us(2024, 7, 11, 23, 26, 22)),
    ("2024-05-06T10:43:14.807779190Z", us(2024, 5, 6, 10, 43, 14, micro=807_779)),
    ("2021-03-17T01:11:51+05:30", us(2021, 3, 16, 19, 41, 51)),
    ("2022-05-21T02:38:12+0530", us(2022, 5, 20, 21, 8, 12)),
    ("2014:06:28 06:34:13-05:00", us(2014, 6, 28, 11, 34, 13)),
    ("20240223T075458Z", us(2024, 2, 23, 7, 54, 58)),
    ("25.10.2011, 10:52:38 UTC", us(2011, 10, 25, 10, 52, 38)),
    ("11.03.2011, 02:21:06 MEZ", us(2011, 3, 11, 1, 21, 6)),
    ("Oct 27, 2013, 2:19:13 AM UTC", us(2013, 10, 27, 2, 19, 13)),
    ("Nov 9, 2016, 12:35:26 AM UTC", us(2016, 11, 9, 0, 35, 26)),
    ("Wed, 25 Mar 2020 10:53:14 -0700", us(2020, 3, 25, 17, 53, 14)),
    (" 2016/05/12 14:18 ", us(2016, 5, 12, 14, 18)),
    ("2012:01:05 23:56:41\x00", us(2012, 1, 5, 23, 56, 41)),
]
NONE = [None, "", "0", "  ", "unknown", "2017:06:03", "2018:02:30 05:50:12", "2019:08:11 24:44:05", "0000:00:00 00:00:00", "    :  :     :  :  ", "2020-01-01T10:00:60Z", "13:00 PM", "2015:05:04 13:21:11 PM", "x" * 100_000]


def test_notations(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(1000 + i, t) for i, t in enumerate(NONE)], "i int, t string").withColumn("s", F.lit(None).cast("string"))
    got = {r.i: r.reading for r in ts.resolve(df, "t", "s").collect()}
    for i, (t, want) in enumerate(CASES):
        assert got[i] is not None, t
        assert got[i].wall_us - (got[i].offset_s or 0) * 1_000_000 == want, t
    assert [NONE[i - 1000] for i in got if i >= 1000 and got[i] is not None] == []


def test_mixture_decides_day_and_month_by_source(spark):
    rows = [("eu", f"{d:02d}/03/2020 10:00:00") for d in range(13, 29)] + [("us", f"03/{d:02d}/2020 10:00:00") for d in range(13, 29)]
    rows += [("eu", "04/05/2020 10:00:00"), ("us", "04/05/2020 10:00:00"), ("new", "04/05/2020 10:00:00"), ("new", "05/05/2020 10:00:00")]
    df = spark.createDataFrame(rows, "s string, t string")
    got = {(r.s, r.t): r.reading for r in ts.resolve(df, "t", "s").collect()}
    assert got["eu", "04/05/2020 10:00:00"].wall_us == us(2020, 5, 4, 10) and not got["eu", "04/05/2020 10:00:00"].ambiguous
    assert got["us", "04/05/2020 10:00:00"].wall_us == us(2020, 4, 5, 10) and not got["us", "04/05/2020 10:00:00"].ambiguous
    assert got["new", "04/05/2020 10:00:00"].ambiguous
    assert not got["new", "05/05/2020 10:00:00"].ambiguous  # both readings are the same day


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([("a", "1458246582", "keep", 1.0)], "s string, t string, fmt string, wall_us double")
    r = ts.resolve(df, "t", "s").first()
    assert (r.fmt, r.wall_us, r.reading.fmt) == ("keep", 1.0, "epoch_s")
    assert ts.resolve(df.where("s = 'z'"), "t", "s").count() == 0


@pytest.mark.parametrize(
    "text, want",
    [("+05:30", 19800), ("+0530", 19800), ("+9", 32400), ("-5", -18000), ("UTC+09:00", 32400), ("−05:00", -18000), (" +10:30 ", 37800), ("UTC", 0), ("Z", 0), ("+14:00", 50400), ("+99:00", None), ("+05:75", None), ("local", None), ("--:--", None), ("", None), (None, None)],
)
def test_offsets(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(ts.parse_offset(F.col("t"))).first()[0] == want


def test_zone_readings(spark):
    df = spark.createDataFrame([("Europe/Berlin", us(2020, 7, 1, 12)), ("Europe/Berlin", us(2020, 3, 29, 2, 30)), ("Europe/Berlin", us(2020, 10, 25, 2, 30)), ("America/New_York", us(2013, 11, 3, 1, 30))], "z string, w long")
    got = [r[0] for r in df.select(ts.zone_readings(F.col("z"), F.col("w"))).collect()]
    assert got[0] == [us(2020, 7, 1, 10)] and got[1] == [] and sorted(got[2]) == [us(2020, 10, 25, 0, 30), us(2020, 10, 25, 1, 30)] and len(got[3]) == 2


def test_disagreement(spark):
    df = spark.createDataFrame([([0], 0, 60_000_000), ([0], 0, 60_000_001), ([], 0, 0), (None, 3 * 900_000_000, 30_000_000), (None, 61 * 900_000_000, 0), (None, 450_000_000, 0)], "i array<long>, w long, o long")
    got = [r[0] for r in df.select(ts.clocks_disagree(F.col("i"), F.col("w"), F.col("o"))).collect()]
    assert got == [False, True, True, False, True, True]


def test_unknown_zone_is_null(spark):
    df = spark.createDataFrame([("Europe/Berlin",), ("Mars/Olympus",), (None,)], "z string")
    assert [r[0] for r in df.select(ts.known_zone(spark, F.col("z"))).collect()] == ["Europe/Berlin", None, None]
