import pytest
from pyspark.sql import functions as F

from darkslide.functions import dates, folders, kinds, names, text

NOW = 1_767_225_600


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("v, want", [("Café", "Café"), ("plain", "plain"), (None, None), ("", "")])
def test_nfc(spark, v, want):
    assert one(spark, v, text.nfc) == want


@pytest.mark.parametrize("v, want", [("CAFÉ.JPG", "café.jpg"), ("ΑΣ", "ασ"), ("İx", "ix"), (None, None)])
def test_fold(spark, v, want):
    assert one(spark, v, text.fold_key) == want


@pytest.mark.parametrize("v, n, want", [("abc", 5, "abc"), ("äöü", 5, "äö"), ("日本語", 7, "日本"), ("😀😀", 7, "😀"), ("", 3, ""), (None, 3, None), ("ä", 1, "")])
def test_fit_bytes(spark, v, n, want):
    assert one(spark, v, lambda c: text.fit_bytes(c, n)) == want


def test_fit_name_keeps_extension(spark):
    got = one(spark, "é" * 300 + ".jpeg", text.fit_name)
    assert got.endswith(".jpeg") and len(got.encode()) <= 255 and len(got.encode()) > 252


@pytest.mark.parametrize("v, want", [(" a \x00\n b ", "a b"), ("a\tb", "a b"), ("plain", "plain"), (None, None)])
def test_clean(spark, v, want):
    assert one(spark, v, text.clean_value) == want


@pytest.mark.parametrize("v, rest, number", [("a(1).jpg", "a.jpg", "1"), ("a (2) (3)", "a  (3)", "2"), ("a.jpg", "a.jpg", "")])
def test_strip_number(spark, v, rest, number):
    r = one(spark, v, text.strip_number)
    assert (r.rest, r.number) == (rest, number)


@pytest.mark.parametrize("v, want", [("IMG-edited", "IMG"), ("IMG-Bearbeitet", "IMG"), ("IMG", "IMG"), ("-edited", "-edited")])
def test_strip_edited(spark, v, want):
    assert one(spark, v, text.strip_edited) == want


@pytest.mark.parametrize("v, want", [("PXL.MP.jpg", "PXL"), ("PXL.mp4", "PXL"), ("IMG.MV", "IMG"), (".hidden", "")])
def test_live_stem(spark, v, want):
    assert one(spark, v, text.live_stem) == want


@pytest.mark.parametrize(
    "v, want",
    [("", "library"), ("Photos from 2019", "library"), ("Фото за 2020", "library"), ("2020 年の写真", "library"), ("Photos from 3019", "album"), ("Trash", "trash"), ("Papierkorb", "trash"), ("Archive", "library"), ("Summer", "album"), ("Photos from 20191", "album")],
)
def test_folder_class(spark, v, want):
    assert one(spark, v, folders.folder_class) == want


@pytest.mark.parametrize("v, want", [("Takeout/Google Photos/A/b/c.jpg", ("A", "c.jpg")), ("Takeout/Google Fotos/c.jpg", ("", "c.jpg")), ("Takeout/Drive/c.jpg", None), ("Takeout/Google Photos/A/", None)])
def test_split_root(spark, v, want):
    r = one(spark, v, folders.split_root)
    assert (r and tuple(r)) == want


@pytest.mark.parametrize("v, want", [("a/b.jpg", True), ("/a", False), ("a\\b", False), ("a/../b", False), ("a/..b", True)])
def test_safe_path(spark, v, want):
    assert one(spark, v, folders.safe_path) is want


@pytest.mark.parametrize(
    "v, want",
    [(b"\xff\xd8\xff\xe0", "jpeg"), (b"GIF89a", "gif"), (b"RIFF\0\0\0\0WEBP", "webp"), (b"RIFF\0\0\0\0AVI ", "avi"), (b"\0\0\0\x18ftypcrx ", "cr3"), (b"\0\0\0\x18ftypheic", "heic"), (b"\0\0\0\x18ftypqt  ", "mov"), (b"\0\0\0\x18ftyp3gp4", "mp4"), (b"BM" + b"\0" * 12, "bmp"), (b"BMxxxxxx", "unknown"), (b"\x1aE\xdf\xa3", "webm"), (b"II*\0", "tiff"), (b"IIRO", "raw"), (b"", "unknown")],
)
def test_sniff(spark, v, want):
    assert one(spark, bytearray(v), kinds.sniff, "binary") == want


@pytest.mark.parametrize("v, want", [("a.JPG", "jpeg"), ("a.mp~2", "mp4"), ("a.mp", "mp4"), ("a.dng", "raw"), ("a.cr3", "cr3"), ("a", "unknown"), ("a.heif", "unknown")])
def test_ext_kind(spark, v, want):
    assert one(spark, v, kinds.ext_kind) == want


@pytest.mark.parametrize("v, want", [("a:b/c", "a-b-c"), ("CON.txt", "CON_.txt"), ("console.txt", "console.txt"), ("name. ", "name"), ("...", "file"), ('a"b?', "a-b-"), ("com1", "com1_")])
def test_sanitize(spark, v, want):
    assert one(spark, v, names.sanitize) == want


def test_sanitize_apple_keeps_quotes(spark):
    assert one(spark, 'a"b?', lambda c: names.sanitize(c, "apple")) == 'a"b?'


@pytest.mark.parametrize(
    "v, want",
    [
        ("IMG_20190914_160000.jpg", (1568476800, "filename")),
        ("Screenshot_2019-09-14-16-00-00.png", (1568476800, "filename")),
        ("20190914160000.jpg", (1568476800, "filename")),
        ("img 1568476800123.jpg", (1568476800, "filename")),
        ("IMG-20190914-WA0001.jpg", (1568462400, "filename-date")),
        ("2019-09-14 party.jpg", (1568462400, "filename-date")),
        ("20190914_party.jpg", (1568462400, "filename-date")),
        ("IMG_20190231_160000.jpg", None),
        ("IMG_18990914_160000.jpg", None),
        ("-20190914_160000.jpg", None),
        ("photo.jpg", None),
        (None, None),
    ],
)
def test_filename_dates(spark, v, want):
    r = one(spark, v, lambda c: dates.from_filename(c, F.lit(NOW)))
    assert (r and tuple(r)) == want


@pytest.mark.parametrize("v, want", [(3600, True), (900, True), (901, False), (50400, True), (51300, False), (-50400, True)])
def test_valid_offset(spark, v, want):
    assert one(spark, v, dates.valid_offset, "long") is want


@pytest.mark.parametrize("v, want", [(19800, "+05:30"), (-12600, "-03:30"), (0, "+00:00")])
def test_format_offset(spark, v, want):
    assert one(spark, v, dates.format_offset, "long") == want


LONG = "00100sPORTRAIT_00100_BURST20181105180120932_COVER.jpg"


@pytest.mark.parametrize(
    "name, want",
    [
        (LONG, LONG + ".supplemental-metadata.json"), (LONG, LONG[:46] + ".json"), ("photo(1).jpg", "photo.jpg.supplemental-metadata(1).json"), ("photo(1).jpg", "photo.jpg(1).json"),
        ("24.02(1).14 - 1", "24.02.14 - 1.supplemental-metadata(1).json"), ("2014-03-05(1).png", "2014-03-05.supplemental-metadata(1).json"), ("20.06.13 - 14.jpg", "20.06.13 - 14.supplemental-metadata.json"),
        ("2014-04-04-edited.jpg", "2014-04-04.jpg.supplemental-metadata.json"), ("LIVE.MP4", "LIVE.MP4.metadata.json"), ("photo-modifié.jpg", "photo.jpg.supplemental-metadata.json"),
        ("PXL_20190914_160000000_holiday_in_lisbon(1).jpg", "PXL_20190914_160000000_holiday_in_lisbon.jpg.s(1).json"),
    ],
)
def test_sidecar_names(name, want):
    from darkslide.operators.sidecars import candidate_names

    assert want in candidate_names(name)


def test_sidecar_names_take_no_others():
    from darkslide.operators.sidecars import candidate_names

    assert "20.06.13 - 90.supplemental-metadata.json" not in candidate_names("20.06.13 - 9.jpg")
    assert "x" + "é" * 22 + "(1).json" not in candidate_names("x" + "é" * 30 + "(1).jpg")


@pytest.mark.parametrize(
    "name, title, want",
    [
        ("IMG_20161116_112442(1).jpg", "IMG_20161116_112442.jpg", True), ("other.jpg", "IMG.jpg", False), ("IMG_0012.MOV", "IMG_0012.HEIC", True), ("PXL_1.MP", "PXL_1.MP.jpg", True), ("PXL_1.MP~2", "PXL_1.MP.jpg", True),
        ("IMG_0013.MOV", "IMG_0012.HEIC", False), ("photo-modifie\u0301.jpg", "photo.jpg", True), ("abc.jpg", "a", False), ("abc.jpg", ".jpg", False), ("abc.jpg", "", True), ("abc.jpg", None, True), (None, "x", False), ("abc.jpg", "abc", True), ("a(2)-edited.png", "a.png", True),
    ],
)
def test_titles(spark, name, title, want):
    from darkslide.operators.sidecars import title_agrees

    df = spark.createDataFrame([(name, title)], "n string, t string")
    assert df.select(text.nfc(F.col("t")).alias("t"), text.nfc(F.col("n")).alias("n")).select(title_agrees(F.col("t"), F.col("n")).alias("x")).first().x is want


def test_rules_of_dates_roots_and_parts(spark):
    from darkslide.operators import archives

    now = F.lit(1_767_225_600)
    rows = ["20191299_998877_20190914_160000.jpg", "Takeout/Google Foto\u0301k/A/b.jpg", "x-takeout-20240101T000000Z-3-x-07.zip", "Takeout/Google Fotók/A/b.jpg"]
    got = spark.createDataFrame([(r,) for r in rows], "v string").select(dates.from_filename(F.col("v"), now)["t"].alias("t"), folders.split_root(F.col("v"))["folder"].alias("f"), archives.part_of(F.col("v"))["part"].alias("p")).collect()
    assert got[0].t == 1568476800 and got[1].f == got[3].f == "A" and got[2].p == 7
    assert spark.createDataFrame([("\u2003 Trip\u3000",)], "v string").select(folders.norm_folder(F.col("v")).alias("x")).first().x == "Trip"
    y = spark.createDataFrame([("Bilder 2019",), ("2019 Fotky",), ("2019",), ("a1b 2019",), ("Trip 20191",), ("1799",)], "v string").select(folders.generic_year(F.col("v")).alias("y")).collect()
    assert [r.y for r in y] == [2019, 2019, 2019, None, None, None]


def test_fallback_root_is_read_again(spark):
    from darkslide.operators import archives

    rows = [("Takeout/Fotosafn/Myndir 2019/a.jpg",), ("Takeout/Fotosafn/Myndir 2019/a.jpg.json",), ("Takeout/Fotosafn/b.jpg",), ("Takeout/index.html",), ("Takeout/Mail/x.mbox",)]
    e = spark.createDataFrame(rows, "entry_name string").withColumn("is_json", F.endswith("entry_name", F.lit(".json"))).withColumn("root", F.lit("clash"))
    got = {(r.folder, r["name"]) for r in archives.under_fallback_root(e).collect()}
    assert got == {("Photos from 2019", "a.jpg"), ("Photos from 2019", "a.jpg.json"), ("", "b.jpg")}
    two = e.union(spark.createDataFrame([("Takeout/Andet/a.jpg", False, ""), ("Takeout/Andet/a.json", True, "")], e.schema))
    assert archives.under_fallback_root(two).count() == 0 and archives.under_fallback_root(e.where("false")).count() == 0
