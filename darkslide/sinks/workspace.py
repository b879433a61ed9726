"""The folder of a run: unpacked archives, a lock for one writer, and a status that others can read."""

from __future__ import annotations

import fcntl
import json
import os
import re
import time
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from darkslide.sources.archives import list_archives

_FORBIDDEN = re.compile(r'[\x00-\x1f\x7f:\\<>"|?*]')


def portable_path(entry: str) -> str:
    """An entry's path with every part fit for any system; empty, `.` and `..` parts are dropped."""
    parts = (_FORBIDDEN.sub("-", p).rstrip(". ") or "file" for p in entry.split("/") if p not in ("", ".", ".."))
    return "/".join(parts)


def _same(path: str, info: zipfile.ZipInfo) -> bool:
    if os.path.getsize(path) != info.file_size:
        return False
    crc = 0
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            crc = zlib.crc32(block, crc)
    return crc == info.CRC


def unpack_archive(path: str, folder: str) -> tuple[int, int, str | None]:
    """(written, kept, error). Files that are there with the right size and checksum stay; another file of that name moves the new one to ` (2)` and on. A mark says when an archive is whole."""
    target = os.path.join(folder, os.path.splitext(os.path.basename(path))[0])
    mark = os.path.join(target, ".complete")
    if os.path.exists(mark):
        return 0, 0, None
    written = kept = 0
    try:
        with zipfile.ZipFile(path) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                want = os.path.join(target, portable_path(info.filename))
                stem, ext = os.path.splitext(want)
                n, at = 1, want
                while os.path.exists(at) and not _same(at, info):
                    n += 1
                    at = f"{stem} ({n}){ext}"
                if os.path.exists(at):
                    kept += 1
                    continue
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with z.open(info) as f, open(at + ".partial", "wb") as out:
                    while block := f.read(1 << 20):
                        out.write(block)
                os.replace(at + ".partial", at)
                written += 1
        open(mark, "w").close()
    except Exception as e:  # a damaged archive is reported with what was written before it
        return written, kept, f"{type(e).__name__}: {e}"[:300]
    return written, kept, None


def unpack(spark: SparkSession, archives: str, folder: str) -> DataFrame:
    """(zip_path, written, kept, error) after unpacking every archive of a folder, one task each; it can be run again."""
    paths = list_archives(archives)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *unpack_archive(p, folder)) for p in b["zip_path"]], columns=["zip_path", "written", "kept", "error"])

    rows = spark.createDataFrame([(p,) for p in paths], "zip_path string")
    return rows.repartition(max(1, len(paths)), "zip_path").mapInPandas(run, "zip_path string, written long, kept long, error string")


class ResultsLock:
    """Holds a results folder for one writer; a second one gets BlockingIOError."""

    def __init__(self, folder: str):
        os.makedirs(folder, exist_ok=True)
        self.path = os.path.join(folder, ".lock")

    def __enter__(self) -> ResultsLock:
        self.file = open(self.path, "w")
        fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        return self

    def __exit__(self, *_) -> None:
        fcntl.flock(self.file, fcntl.LOCK_UN)
        self.file.close()


def write_status(folder: str, phase: str, done: int, total: int, now: float | None = None) -> None:
    """The status of a run, replaced whole."""
    at = os.path.join(folder, "status.json")
    with open(at + ".partial", "w") as f:
        json.dump({"phase": phase, "done": done, "total": total, "pid": os.getpid(), "updated_at": now or time.time()}, f)
    os.replace(at + ".partial", at)


def read_status(folder: str, now: float | None = None, fresh: float = 90.0, patient: float = 600.0) -> dict | None:
    """The last status with `state`: done, running (fresh, or patient while its process lives) or stale. None where no run was."""
    at = os.path.join(folder, "status.json")
    if not os.path.exists(at):
        return None
    with open(at) as f:
        s = json.load(f)
    age = (now or time.time()) - s["updated_at"]
    alive = os.path.exists(f"/proc/{s['pid']}")
    s["state"] = "done" if s["phase"] == "done" else "running" if age <= fresh or (alive and age <= patient) else "stale"
    return s
