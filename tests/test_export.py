import json
import os
import zipfile
import zlib
from types import SimpleNamespace

import pytest

from darkslide.plans.export import Options, plan
from darkslide.sinks import effects
from darkslide.sources import journal as journal_source
from darkslide.sources.archives import ArchiveSource
from darkslide.streaming import journal as journal_stream

NOW = 1_767_225_600
BASE = "Takeout/Google Photos/"


def sidecar(title, taken, **more):
    return json.dumps({"title": title, "photoTakenTime": {"timestamp": str(taken)}, **more})


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    folder = tmp_path_factory.mktemp("export [1]")
    one = {
        "Photos from 2019/a.jpg": b"\xff\xd8\xffaaaa", "Photos from 2019/a.jpg.json": sidecar("a.jpg", 1568476800),
        "Photos from 2019/live.heic": b"\0\0\0\x18ftypheic-bytes", "Photos from 2019/live.heic.json": sidecar("live.heic", 1568476900), "Photos from 2019/live.mov": b"\0\0\0\x14ftypqt  mov-bytes",
        "Photos from 2019/IMG_20190914_160000.png": b"png", "Photos from 2019/none.gif": b"gif-bytes!", "Photos from 2019/readme.txt": b"text of a file",
        "Trash/gone.jpg": b"gone-bytes-here", "Trash/gone.jpg.json": sidecar("gone.jpg", 1568470000), "Photos from 2019/.DS_Store": b"x", "Summer/metadata.json": "{}",
    }
    two = {"Summer/a.jpg": b"\xff\xd8\xffaaaa", "Summer/b.jpg": b"bbbbbbbb", "Summer/B.JPG.json": sidecar("b.jpg", 1568477000), "Photos from 2019/bad.json": "not json"}
    for n, files in (("001", one), ("002", two)):
        with zipfile.ZipFile(folder / f"takeout-20240101T000000Z-1-{n}.zip", "w") as z:
            z.writestr("Takeout/archive_browser.html", "x")
            for name, body in files.items():
                z.writestr(BASE + name, body)
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, export):
    spark.dataSource.register(ArchiveSource)
    index = spark.read.format("archives").option("path", export).load()
    bodies = spark.read.format("archives").option("path", export).option("mode", "content").option("suffix", ".json").load()
    return index, bodies


def test_directory_rows(tables):
    rows = tables[0].collect()
    assert len(rows) == 18 and {r.zip_ord for r in rows} == {0, 1}
    assert all(r.crc32 >= 0 and not r.is_symlink for r in rows)


def test_plan(tables):
    p = plan(*tables, Options(NOW))
    groups = {r.canon.name: r for r in p.groups.collect()}
    assert groups["a.jpg"].n_members == 2 and groups["a.jpg"].canon.folder == "Photos from 2019"
    assert (groups["live.mov"].source, groups["live.mov"].t) == ("live", 1568476900)
    assert groups["IMG_20190914_160000.png"].source == "filename" and groups["none.gif"].t is None
    assert groups["b.jpg"].source == "json-taken"  # its sidecar differs in case only
    fates = {r.id: r.fate for r in p.fates.collect()}
    names = {r.id: r.entry_name.removeprefix(BASE) for r in p.entries.collect()}
    by_name = {names[i]: f for i, f in fates.items()}
    assert by_name["Summer/a.jpg"] == "album-clone" and by_name["Trash/gone.jpg"] == "excluded-trash" and by_name["Photos from 2019/readme.txt"] == "not-importable"
    assert by_name["Photos from 2019/.DS_Store"] == "system-file" and "error" not in by_name.values() and len(fates) == len(names)
    dirs = {r.base: r.dir for r in p.placement.collect()}
    assert dirs["a.jpg"] == "2019" and dirs["none.gif"] == "unknown" and dirs["readme.txt"] == "not-importable"
    assert {(r.metric, r.key): r.value for r in p.report.collect()}[("date_sources", "json-taken")] == 3


def test_unsafe_paths_stop_the_plan(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr(BASE + "A/../b.jpg", "x")
    spark.dataSource.register(ArchiveSource)
    read = lambda mode: spark.read.format("archives").option("path", str(tmp_path)).option("mode", mode).load()
    with pytest.raises(Exception, match="unsafe path"):
        plan(read("index"), read("content"), Options(NOW)).groups.collect()


def test_effects_run_twice(spark, tables, tmp_path):
    index, _ = tables
    staged = effects.stage(index.where("entry_name like '%a.jpg'"), str(tmp_path / "staged")).collect()
    assert len(staged) == 2 and len({r.sha256 for r in staged}) == 1 and os.listdir(tmp_path / "staged") == [staged[0].sha256]
    row = SimpleNamespace(id="g", sha=staged[0].sha256, path="2019/a.jpg", year="2019", name="a.jpg", albums=["albums/Summer/a.jpg"])
    log = effects.Journal(str(tmp_path / "journal.jsonl"))
    assert effects.place([row], str(tmp_path / "staged"), str(tmp_path / "lib"), log) == 1
    assert effects.place([row], str(tmp_path / "staged"), str(tmp_path / "lib"), log) == 0
    assert effects.clone_albums([row], str(tmp_path / "lib"), log) == 1 and effects.clone_albums([row], str(tmp_path / "lib"), log) == 0
    log.close()
    with open(tmp_path / "journal.jsonl", "a") as f:
        f.write('{"id": "torn')
    effects.Journal(str(tmp_path / "journal.jsonl")).close()
    assert journal_source.read(spark, str(tmp_path / "journal.jsonl")).count() == 6


def test_report_files(spark, tmp_path):
    r = spark.createDataFrame([("fates", "library", 3), ("years", "2019", 1)], "metric string, key string, value long")
    assert effects.write_report(r, str(tmp_path)) == {"fates": {"library": 3}, "years": {"2019": 1}}
    assert "library: 3" in (tmp_path / "report.txt").read_text()


def test_journal_stream_keeps_the_latest(spark, tmp_path):
    src, out, check = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    (src / "a.jsonl").write_text('{"id":"a","stage":"staged"}\n{"id":"b","stage":"staged"}\n{"id":"b","stage":"placed"}\n')
    journal_stream.keep_latest(journal_stream.lines(spark, str(src)), out, check).awaitTermination()
    assert {r.id: r.stage for r in journal_stream.current(spark, out).collect()} == {"a": "staged", "b": "placed"}
    (src / "b.jsonl").write_text('{"id":"a","stage":"cloned"}\n{"torn\n')
    journal_stream.keep_latest(journal_stream.lines(spark, str(src)), out, check).awaitTermination()
    assert {r.id: r.stage for r in journal_stream.current(spark, out).collect()} == {"a": "cloned", "b": "placed"}


def test_contents_that_share_size_and_crc_are_two_groups(spark, tmp_path):
    # CRC-32 is linear: the generator polynomial, shifted into the body, leaves the CRC as it is
    zero = bytes(16)
    twin = bytearray(zero)
    twin[4:9] = ((0x104C11DB7 << 7).to_bytes(5, "big")[i] for i in range(5))
    twin = bytes(int(f"{b:08b}"[::-1], 2) for b in twin)
    assert zlib.crc32(zero) == zlib.crc32(twin) and zero != twin
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for name, body in {"a.jpg": zero, "b.jpg": twin, "c.jpg": twin}.items():
            z.writestr(f"{BASE}Photos from 2019/{name}", body)
    spark.dataSource.register(ArchiveSource)
    read = lambda mode: spark.read.format("archives").option("path", str(tmp_path)).option("mode", mode).load()
    p = plan(read("index"), read("content").where("entry_name like '%.json'"), Options(NOW))
    groups = {r.canon.name: r for r in p.groups.collect()}
    assert {k: r.n_members for k, r in groups.items()} == {"a.jpg": 1, "b.jpg": 2}
    first, second = sorted(groups.values(), key=lambda r: len(r.group_id))
    assert second.group_id.startswith(first.group_id + ":") and len(second.group_id) == len(first.group_id) + 13
    assert sorted(r.base for r in p.placement.collect()) == ["a.jpg", "b.jpg"]


JPEG, HEIC, MOV = b"\xff\xd8\xff\xe0", b"\0\0\0\x18ftypheic", b"\0\0\0\x14ftypqt  "


def _read(spark, folder, files):
    with zipfile.ZipFile(folder / "takeout-20240101T000000Z-1-001.zip", "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    spark.dataSource.register(ArchiveSource)
    index = spark.read.format("archives").option("path", str(folder)).load()
    return index, spark.read.format("archives").option("path", str(folder)).option("mode", "content").option("suffix", ".json").load()


def test_the_whole_plan(spark, tmp_path):
    from pyspark.sql import functions as F

    day = 1568476800
    files = {
        # three copies of a small image with three times: a stand-in for lost files
        **{f"Takeout/Myndir/{a}/lost.jpg": JPEG + b"gone" for a in ("2019 ferð", "A", "B")}, **{f"Takeout/Myndir/{a}/lost.jpg.json": sidecar("lost.jpg", day + i * 9999) for i, a in enumerate(("2019 ferð", "A", "B"))},
        # a live photo by identifier, and one by name that shares its number with another photo of its name
        "Takeout/Myndir/2019 ferð/still.heic": HEIC + b"1", "Takeout/Myndir/2019 ferð/moving.mov": MOV + b"1", "Takeout/Myndir/2019 ferð/still.heic.json": sidecar("still.heic", day),
        "Takeout/Myndir/2019 ferð/two.jpg": JPEG + b"first", "Takeout/Myndir/2019 ferð/two.jpg.json": sidecar("two.jpg", day),
        "Takeout/Myndir/C/two.heic": HEIC + b"2", "Takeout/Myndir/C/two.mov": MOV + b"2", "Takeout/Myndir/C/two.heic.json": sidecar("two.heic", day),
        # an extension that is not that of the bytes, a time from the camera alone, a place, a video dated by its name
        "Takeout/Myndir/2019 ferð/wrong.png": JPEG + b"wrong", "Takeout/Myndir/2019 ferð/camera.jpg": JPEG + b"camera MotionPhoto", "Takeout/Myndir/2019 ferð/place.jpg": JPEG + b"place",
        "Takeout/Myndir/2019 ferð/place.jpg.json": sidecar("place.jpg", day, geoData={"latitude": 52.5, "longitude": 13.4, "altitude": 0}),
        "Takeout/Myndir/2019 ferð/VID_20190914_160000.mov": MOV + b"by name", "Takeout/Myndir/2019 ferð/raw.dng": b"II*\0raw", "Takeout/Myndir/2019 ferð/raw.jpg": JPEG + b"raw",
    }
    index, bodies = _read(spark, tmp_path, files)
    at = {r.entry_name.removeprefix("Takeout/Myndir/"): r for r in index.collect()}
    zip_path = next(iter(at.values())).zip_path
    tag = lambda n, dto=None, off=None, cid=None: (zip_path, at[f"2019 ferð/{n}"].entry_ord, dto, off, cid)
    tags = spark.createDataFrame([tag("still.heic", cid="X"), tag("moving.mov", cid="X"), tag("camera.jpg", "2019:09:14 10:00:00", "+02:00")], "zip_path string, entry_ord int, dto string, offset_time string, content_identifier string")
    regions = spark.createDataFrame([(1, "circle", 52.5, 13.4, 50_000.0, None, "Europe/Berlin")], "region_id long, shape string, lat double, lon double, radius_m double, ring array<struct<lon:double,lat:double>>, zone string")
    taken = spark.createDataFrame([("2019", "place.jpg")], "dir string, name string")
    p = plan(index, bodies, Options(NOW, default_zone="Europe/Berlin"), tags, regions, taken)
    g = {r.canon.name: r for r in p.groups.collect()}
    assert g["lost.jpg"].placeholder and g["lost.jpg"].fate == "placeholder" and g["lost.jpg"].n_members == 3
    assert g["wrong.png"].kind == "jpeg" and g["raw.dng"].kind == "raw" and g["camera.jpg"].motion
    assert (g["camera.jpg"].source, g["camera.jpg"].t, g["camera.jpg"].offset_s) == ("embedded", day - 8 * 3600, 7200)
    assert (g["place.jpg"].tz_step, g["place.jpg"].offset_s) == ("gps", 7200) and (g["moving.mov"].source, g["moving.mov"].t) == ("live", day)
    v = g["VID_20190914_160000.mov"]
    assert (v.source, v.t, v.offset_s, v.year) == ("filename", 1568476800 - 7200, 7200, 2019)
    assert sorted((r.how for r in p.pairs.collect())) == ["content-id", "stem"] and p.raw_pairs.count() == 1
    names_ = {(r.dir, r.base): r.name for r in p.placement.collect()}
    assert names_["placeholders", "lost.jpg"] == "lost.jpg" and names_["2019", "place.jpg"] == "place (2).jpg" and names_["unknown", "wrong.jpg"] == "wrong.jpg"
    assert names_["2019", "two.jpg"] == "two.jpg" and names_["2019", "two.heic"] == "two (2).heic" and names_["2019", "two.MOV"] == "two (2).MOV"
    assert len({(r.dir, r.name) for r in p.placement.collect()}) == p.placement.count() == len(g)
    report_ = {(r.metric, r.key): r.value for r in p.report.collect()}
    assert report_["placeholders", "yes"] == 1 and report_["live_pairs", "content-id"] == 1 and report_["motion_photos", "yes"] == 1
    assert {r.fate for r in p.fates.where(F.col("fate") == "error").collect()} == set() and p.fates.count() == len(files)
    assert p.conflicts.count() == 1


def test_numbers_of_a_hot_stem_and_of_pairs(spark):
    from darkslide.operators import placing

    rows = [(i, "unknown", "IMG_1.jpg", i, None) for i in range(500)] + [(1000, "unknown", "IMG_1.mov", 1000, "7"), (7, "x", "b.heic", 1, "p"), (8, "x", "b.mov", 2, "p"), (9, "x", "b.png", 3, None), (10, "x", "c (2).jpg", 4, None), (11, "x", "c.jpg", 5, None), (12, "x", "c.jpg", 6, None), (13, "y", "d.jpg", 1, None)]
    f = spark.createDataFrame(rows, "id long, dir string, name string, ord long, pair string").withColumn("n", __import__("pyspark").sql.functions.lit("clash"))
    taken = spark.createDataFrame([("y", "D.jpg"), ("y", "d (2).jpg"), ("z", "q.jpg")], "dir string, name string")
    got = {(r.dir, r.id): r.name for r in placing.number_names(f, taken).collect()}
    assert len(got) == len(rows) and len(set((d, n.lower()) for (d, _), n in got.items())) == len(rows)
    assert got["unknown", 0] == "IMG_1.jpg" and got["unknown", 499] == "IMG_1 (500).jpg" and got["x", 8] == "b.mov" and got["x", 9] == "b (2).png"
    assert got["x", 10] == "c (2).jpg" and got["x", 11] == "c.jpg" and got["x", 12] == "c (3).jpg" and got["y", 13] == "d (3).jpg"
    assert placing.number_names(f.where("false"), taken).count() == 0
