import random

from pyspark.sql import functions as F

from darkslide.operators import archives, dedup, journal, ledger, pairs, placing, report, sidecars, tags, zones


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_missing_parts(spark):
    z = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4), ("b", 1), (None, 2), ("c", None)], "export_id string, part int")
    assert rows(archives.missing_in_sequence(z, "export_id", "part")) == [("a", 2), ("a", 3)]


def test_fallback_root_needs_one(spark):
    e = spark.createDataFrame([("Takeout/A/x/1.json", True), ("Takeout/A/x/1.jpg", False), ("Takeout/B/2.jpg", False), ("Takeout/C.jpg", False)], "entry_name string, is_json boolean")
    assert rows(archives.fallback_roots(e)) == [("A", 1, 1, True)]
    two = e.union(spark.createDataFrame([("Takeout/B/2.json", True)], e.schema))
    assert [r[3] for r in rows(archives.fallback_roots(two))] == [False, False]


def test_confirmed_groups(spark):
    d = spark.createDataFrame([(1, 5, "x"), (2, 5, "y"), (3, 5, "x"), (4, 7, "z"), (5, 5, None)], "id int, size int, body string")
    got = {r.id: (r.members, r.group_rank) for r in dedup.confirmed_groups(d, ["size"], F.sha2("body", 256), "id").collect()}
    assert got[1] == got[3] and got[1][0] == 2 and got[2][0] == 1 and got[4] == (1, 1) and got[5] == (1, 3)


def test_canonical_prefers_photo_folders(spark):
    m = spark.createDataFrame([("g", "Summer", 1), ("g", "Archive", 2), ("g", "Photos from 2020", 3), ("g", "Photos from 2019", 4), ("g", "Trash", 0)], "g string, folder string, ord int")
    assert rows(dedup.canonical(m, ["g"], "folder", "ord")) == [("g", 3, 5)]


def test_greedy_distinct_depends_on_order(spark):
    a = spark.createDataFrame([("g", 0, 0), ("g", 50, 1), ("g", 100, 2)], "g string, t long, o int")
    b = spark.createDataFrame([("g", 50, 0), ("g", 0, 1), ("g", 100, 2)], "g string, t long, o int")
    assert dedup.distinct_times(a, "g", "t", "o", 60).first().n == 2
    assert dedup.distinct_times(b, "g", "t", "o", 60).first().n == 1


def test_conflicts_take_the_first(spark):
    m = spark.createDataFrame([("g", 0, 0, 0), ("g", 50, 1, 0), ("g", 100, 2, 0), ("g", 500, 3, 0), ("h", 1, 5, 5)], "g string, t long, o int, c int")
    assert rows(dedup.conflicts(m, "g", "t", "o", "c")) == [("g", 2, 100)]


def test_sidecar_match_passes(spark):
    S = "id string, folder string, name string, ord int"
    media = spark.createDataFrame([("m1", "f", "a.jpg", 1), ("m2", "f", "B.jpg", 2), ("m3", "f", "c.jpg", 3), ("m4", "g", "a.jpg", 4), ("m5", "f", "d(1).jpg", 5), ("m6", "f", "e-edited.jpg", 6), ("m7", "f", "Café.jpg", 7), ("m8", "f", None, 8)], S)
    side = spark.createDataFrame(
        [("s1", "f", "a.jpg.json", 1), ("s1b", "f", "a.jpg.json", 9), ("s2", "f", "b.jpg.json", 2), ("s3", "f", "C.jpg.json", 3), ("s3b", "f", "C.JPG.json", 4), ("s5", "f", "d.jpg(1).json", 5), ("s6", "f", "e.jpg.supplemental-metadata.json", 6), ("s7", "f", "Café.jpg.json", 7)], S
    )
    got = {r.media_id: (r.sidecar_id, r["pass"]) for r in sidecars.match(media, side).collect()}
    assert got == {"m1": ("s1b", 1), "m2": ("s2", 3), "m5": ("s5", 1), "m6": ("s6", 1), "m7": ("s7", 1)}


def test_candidates_are_cut_by_bytes():
    c = sidecars.candidate_names("ä" * 40 + ".jpg")
    assert all(len(x.encode()) <= 51 or x.endswith(("metadata.json", ".jpg.json", "ä.json")) for x in c) and "ä" * 23 + ".json" in c


def test_parse_is_tolerant(spark):
    j = ['{"title":"a","photoTakenTime":{"timestamp":"12"},"creationTime":{"timestamp":34},"geoData":{"latitude":0,"longitude":0},"geoDataExif":{"latitude":1.5,"longitude":2,"altitude":0}}', '{"photoTakenTime":{"timestamp":"x"},"title":5}', "[1]", "nonsense", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in j], "j string").select(sidecars.parse(F.col("j"))).collect()]
    assert (got[0].title, got[0].taken, got[0].creation, got[0].lat, got[0].lon, got[0].alt) == ("a", 12, 34, 1.5, 2.0, None)
    assert got[1].taken is None and got[2:] == [None, None, None]


def test_nearest_donor_brute_force(spark):
    rnd = random.Random(5)
    donors = [(rnd.randrange(0, 2_000_000), rnd.randrange(-50, 50) * 900, i) for i in range(300)]
    asked = [(i, rnd.randrange(-200_000, 2_300_000)) for i in range(500)] + [(900, donors[0][0])]
    got = {r.id: (r.value, r.distance) for r in zones.nearest_donor(spark.createDataFrame(asked, "id long, t long"), spark.createDataFrame(donors, "t long, value long, ord long")).collect()}
    want = {}
    for i, t in asked:
        near = [(abs(d - t), o, v) for d, v, o in donors if abs(d - t) <= zones.REACH]
        if near:
            d, _, v = min(near)
            want[i] = (v, d)
    assert got == want and len(want) < len(asked)


def test_fill_offsets_chain(spark):
    S = "id long, ord long, t long, offset_s long, tz_step string, source string"
    df = spark.createDataFrame([(1, 1, 1000, 3600, "gps", "json-taken"), (2, 2, 2000, None, None, "json-taken"), (3, 3, 10_000_000, None, None, "json-taken"), (4, 4, 1500, None, "filename", "filename"), (5, 5, None, None, None, None)], S)
    got = {r.id: (r.offset_s, r.tz_step) for r in zones.fill_offsets(df).collect()}
    assert got == {1: (3600, "gps"), 2: (3600, "neighbor"), 3: (3600, "common"), 4: (None, "filename"), 5: (None, None)}
    assert {r.id: r.tz_step for r in zones.fill_offsets(df, "Europe/Berlin").collect()}[3] == "default"
    assert {r.tz_step for r in zones.fill_offsets(df.where("id = 3")).collect()} == {"utc"}


def test_mode_breaks_ties_by_first(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4), (None, 0), (None, 9), (None, 10)], "v string, o int")
    assert zones.first_mode(df, "v", "o").first().v == "b"


def test_pairs(spark):
    S = "id string, kind string, folder string, stem string, ord long, content_id string"
    g = spark.createDataFrame(
        [("i1", "heic", "f", "a", 1, "X"), ("v1", "mov", "f", "a", 2, "X"), ("i2", "jpeg", "f", "b", 3, None), ("i3", "heic", "f", "b", 4, None), ("v2", "mp4", "f", "b", 5, None), ("i4", "jpeg", "f", "c", 6, None), ("v3", "mp4", "f", "c", 7, None), ("v4", "mp4", "f", "c", 8, None), ("r", "raw", "f", "d", 9, None), ("j", "jpeg", "f", "d", 10, None)], S
    )
    p = pairs.live_pairs(g)
    assert rows(p) == [("i1", "v1", "content-id"), ("i3", "v2", "stem")]
    assert rows(pairs.raw_pairs(g, p.select(F.explode(F.array("image", "video")).alias("id")))) == [("r", "j")]
    d = spark.createDataFrame([("i3", 5, "json-taken"), ("v2", None, None)], "id string, t long, source string")
    assert {r.id: (r.t, r.source) for r in pairs.propagate(d, p).collect()}["v2"] == (5, "live")


def test_numbers_avoid_names_that_look_numbered(spark):
    f = spark.createDataFrame([(1, "d", "x.jpg", 1), (2, "d", "X.jpg", 2), (3, "d", "x (2).jpg", 3), (4, "d", "x.png", 4), (5, "e", "x.jpg", 5), (6, "d", "y", 6), (7, "d", "y", 7)], "id long, dir string, name string, ord long")
    got = {r.id: r.name for r in placing.number_names(f).collect()}
    assert len({(r.dir, r.name.lower()) for r in placing.number_names(f).collect()}) == 7
    assert got[1] == "x.jpg" and got[2] == "X (2).jpg" and got[5] == "x.jpg" and got[7] == "y (2)"


def test_album_numbers(spark):
    f = spark.createDataFrame([("a", "Trip"), ("b", "trip"), ("c", "Trip (2)"), ("d", "Other")], "folder string, name string")
    got = dict(rows(placing.number_folders(f)))
    assert got["a"] == "Trip" and got["b"] == "trip (2)" and got["c"] == "Trip (2) (2)" and got["d"] == "Other"


def test_stride_sample(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "k")
    assert [r.k for r in placing.stride_sample(df, "k", 10).orderBy("k").collect()] == [i * 100 for i in range(10)]
    assert placing.stride_sample(df.where("k < 3"), "k", 10).count() == 3


def test_arguments(spark):
    df = spark.createDataFrame([("jpeg", 1568476800, 7200, 1.5, -2.0, 10.0, "a\n b"), ("mp4", 1568476800, None, 1.5, -2.0, None, None), ("gif", 1568476800, 3600, None, None, None, "x")], "kind string, t long, o long, lat double, lon double, alt double, d string")
    got = [r[0] for r in df.select(tags.arguments(F.col("kind"), F.lit(True), F.col("lat").isNotNull(), F.col("t"), F.col("o"), F.col("lat"), F.col("lon"), F.col("alt"), F.col("d"))).collect()]
    assert "-EXIF:DateTimeOriginal=2019:09:14 18:00:00" in got[0] and "-EXIF:OffsetTime=+02:00" in got[0] and "-GPSLongitudeRef=W" in got[0] and "-Description=a b" in got[0]
    assert "-Keys:CreationDate=2019:09:14 16:00:00" in got[1] and "-Keys:GPSCoordinates=1.500000, -2.000000" in got[1]
    assert got[2] == ["-XMP-exif:DateTimeOriginal=2019:09:14 17:00:00+01:00"]


def test_ledger(spark):
    e = spark.createDataFrame([(1, False, False, False, False), (2, True, False, False, False), (3, False, True, False, False), (4, False, False, True, False), (5, False, False, False, True), (6, False, False, False, False)], "id long, is_symlink boolean, is_system boolean, is_json boolean, is_screenshot boolean")
    f = ledger.entry_fates(e, spark.createDataFrame([(1, "library"), (1, "library")], "id long, fate string"))
    assert dict(rows(f)) == {1: "library", 2: "symlink-skipped", 3: "system-file", 4: "skipped-json", 5: "excluded-screenshot", 6: "error"}
    assert ledger.balance(e, f).first().balanced
    assert not ledger.balance(e, f.where("id < 6")).first().balanced
    assert dict(rows(ledger.by_priority([f, spark.createDataFrame([(6, "late")], "id long, fate string")], "id", "fate")))[6] == "late"


def test_report_and_codes(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, y int")
    assert rows(report.rollup(df, {"k": F.col("k"), "y": F.col("y")})) == [("k", "a", 2), ("k", "b", 1), ("y", "1", 1), ("y", "2", 1)]
    errs = spark.createDataFrame([(i, f"e{i}") for i in range(5)], "o int, m string")
    assert [r.message for r in report.first_errors(errs, "m", "o", 2).collect()] == ["e0", "e1", "and 3 more"]
    one = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 2, 1), (0, 0, 1)], "a int, b int, c int")
    assert [r[0] for r in one.select(report.exit_code(F.col("a"), F.col("b"), F.col("c"))).collect()] == [0, 2, 3, 4]


def test_journal_queries(spark):
    j = spark.createDataFrame([(1, "a", "staged", None, None), (2, "a", "placed", "2020/x", ["al/x"]), (3, "b", "cloned", "2020/y", None), (4, None, "staged", None, None)], "n int, id string, stage string, path string, albums array<string>")
    last = journal.latest(j, "id", "n")
    assert {r.id: r.stage for r in last.collect()} == {"a": "placed", "b": "cloned"}
    g = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert rows(journal.pending(g, last, "id")) == [("a", "albums"), ("c", "all")]
    assert rows(journal.missing_files(last, spark.createDataFrame([("2020/x",)], "path string"))) == [("2020/y",), ("al/x",)]


def test_distinct_times_by_rounds_are_the_greedy_ones(spark):
    import random

    from darkslide.operators import dedup

    r = random.Random(4)
    rows = [(g, i, r.choice([None, r.randrange(0, 200)])) for g in range(60) for i in range(r.randrange(0, 9))] + [(99, i, 5) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, o long, t long").withColumn("_k", __import__("pyspark").sql.functions.lit("clash"))
    for least in (1, 2, 3):
        want = set()
        for g in {x[0] for x in rows}:
            kept = []
            for _, t in sorted((o, t) for a, o, t in rows if a == g and t is not None):
                if all(abs(t - k) > 30 for k in kept):
                    kept.append(t)
            if len(kept) >= least:
                want.add(g)
        assert {x.g for x in dedup.with_distinct_times(df, "g", "t", "o", 30, least).collect()} == want
    assert dedup.with_distinct_times(df.where("false"), "g", "t", "o", 30, 3).count() == 0
