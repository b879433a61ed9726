import zipfile

import pytest

from darkslide.sinks import workspace
from darkslide.sources.results import listing


def test_unpack_can_be_run_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "a.ZIP", "w") as z:
        z.writestr("x/b:c.txt", "one")
        z.writestr("x/b-c.txt", "two")
        z.writestr("../up.txt", "three")
    (tmp_path / "in" / "bad.zip").write_bytes(b"no archive")
    got = {r.zip_path[-7:]: (r.written, r.kept, r.error is None) for r in workspace.unpack(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert got["n/a.ZIP"] == (3, 0, True) and got["bad.zip"][2] is False
    assert {r.path for r in listing(spark, str(tmp_path / "out")).collect()} >= {"a/x/b-c.txt", "a/x/b-c (2).txt", "a/up.txt"}
    (tmp_path / "out" / "a" / ".complete").unlink()
    again = {r.zip_path[-7:]: (r.written, r.kept) for r in workspace.unpack(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert again["n/a.ZIP"] == (0, 3)


def test_listing(spark, tmp_path):
    (tmp_path / "2019").mkdir()
    (tmp_path / "2019" / "a b+é.jpg").write_bytes(b"123")
    (tmp_path / "top.txt").write_bytes(b"1")
    assert sorted((r.path, r.folder, r.length) for r in listing(spark, str(tmp_path)).collect()) == [("2019/a b+é.jpg", "2019", 3), ("top.txt", "", 1)]


def test_lock_and_status(tmp_path):
    with workspace.ResultsLock(str(tmp_path)), pytest.raises(BlockingIOError):
        workspace.ResultsLock(str(tmp_path)).__enter__()
    assert workspace.read_status(str(tmp_path)) is None
    workspace.write_status(str(tmp_path), "place", 1, 2, now=1000)
    assert [workspace.read_status(str(tmp_path), now=n)["state"] for n in (1050, 1500, 2000)] == ["running", "running", "stale"]
    workspace.write_status(str(tmp_path), "done", 2, 2, now=1000)
    assert workspace.read_status(str(tmp_path), now=9999)["state"] == "done"


def _journal(path):
    import json

    return [json.loads(x) for x in open(path)]


def test_a_taken_path_is_never_called_placed(tmp_path):
    import hashlib
    from types import SimpleNamespace as Row

    from darkslide.sinks import effects

    staged, library = tmp_path / "staged", tmp_path / "library"
    (library / "2019").mkdir(parents=True)
    staged.mkdir()
    sha = {b: hashlib.sha256(b).hexdigest() for b in (b"one", b"two", b"six")}
    for b, h in sha.items():
        (staged / h).write_bytes(b)
    (library / "2019" / "a.jpg").write_bytes(b"other")
    (library / "2019" / "b.jpg").write_bytes(b"two")  # an earlier run ended between the move and its record
    rows = [Row(id=str(i), sha=h, path=f"2019/{n}.jpg", year="2019", name=f"{n}.jpg") for i, (n, h) in enumerate(zip("abc", sha.values()))]
    j = effects.Journal(str(tmp_path / "j"))
    assert effects.place(iter(rows), str(staged), str(library), j) == 1
    last = {r["id"]: (r["stage"], r.get("error")) for r in _journal(tmp_path / "j")}
    assert last == {"0": ("placing", "another file has this path"), "1": ("placed", None), "2": ("placed", None)}
    assert (staged / sha[b"one"]).exists() and not (staged / sha[b"two"]).exists() and (library / "2019" / "a.jpg").read_bytes() == b"other"
    assert effects.place(iter(rows[1:]), str(staged), str(library), j) == 0  # run again
    gone = [Row(id="9", sha="0" * 64, path="2019/z.jpg", year="2019", name="z.jpg")]
    effects.place(iter(gone), str(staged), str(library), j)
    assert _journal(tmp_path / "j")[-1]["error"] == "the staged file is missing"
    albums = [Row(id="2", sha=sha[b"six"], path="2019/c.jpg", albums=["Trip/c.jpg", "Trip/taken.jpg"])]
    (library / "Trip").mkdir()
    (library / "Trip" / "taken.jpg").write_bytes(b"half")
    (library / "Trip" / ".c.jpg.1.partial").write_bytes(b"s")  # what a crash left
    assert effects.clone_albums(iter(albums), str(library), j) == 1 and (library / "Trip" / "c.jpg").read_bytes() == b"six"
    assert _journal(tmp_path / "j")[-1]["stage"] == "placed" and (library / "Trip" / "taken.jpg").read_bytes() == b"half"
    (library / "Trip" / "taken.jpg").unlink()
    assert effects.clone_albums(iter(albums), str(library), j) == 1 and _journal(tmp_path / "j")[-1]["stage"] == "cloned"
