"""Side effects behind a plan: staging by hash, placing without replacing, albums, reports and the journal.

Each step can be run again: a staged file is named by its content, a placed one is never overwritten, and the
journal says before and after what is done. Paths are computed by the plan; nothing here decides where a file goes.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def put_no_replace(source: str, target: str) -> bool:
    """Moves a file unless the target exists; False if it does. By hard link where the system has them, else by a checked copy."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    try:
        os.link(source, target)
    except FileExistsError:
        return False
    except OSError:
        if os.path.exists(target):
            return False
        part = os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.partial")
        shutil.copy2(source, part)
        os.rename(part, target)
    os.unlink(source)
    return True


def stage(entries: DataFrame, folder: str) -> DataFrame:
    """(zip_path, entry_name, sha256, error) after copying the entries (zip_path, entry_name) of archives to files named by their hash. Bodies never enter the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            rows = []
            for path, group in b.groupby("zip_path"):
                with zipfile.ZipFile(path) as z:
                    rows += [(path, name, *_copy(z, name, folder)) for name in group["entry_name"]]
            yield pd.DataFrame(rows, columns=["zip_path", "entry_name", "sha256", "error"])

    return entries.select("zip_path", "entry_name").mapInPandas(run, "zip_path string, entry_name string, sha256 string, error string")


def _copy(z: zipfile.ZipFile, name: str, folder: str) -> tuple[str | None, str | None]:
    part = os.path.join(folder, f".{hashlib.sha256(f'{z.filename}/{name}'.encode()).hexdigest()}.{os.getpid()}.partial")
    digest = hashlib.sha256()
    try:
        with z.open(name) as f, open(part, "wb") as out:
            while block := f.read(1 << 20):
                digest.update(block)
                out.write(block)
    except Exception as e:  # a damaged entry is reported, not retried for ever
        if os.path.exists(part):
            os.unlink(part)
        return None, f"{type(e).__name__}: {e}"[:300]
    os.replace(part, os.path.join(folder, digest.hexdigest()))
    return digest.hexdigest(), None


class Journal:
    """Appends records as JSON lines, each on disk before the next step; a torn last line of an earlier run is closed first."""

    def __init__(self, path: str):
        self.path = path
        torn = os.path.exists(path) and os.path.getsize(path) > 0 and open(path, "rb").read()[-1:] != b"\n"
        self.file = open(path, "a", encoding="utf-8")
        if torn:
            self.file.write("\n")

    def put(self, **record) -> None:
        self.file.write(json.dumps({k: v for k, v in record.items() if v is not None}, ensure_ascii=False) + "\n")
        self.file.flush()
        os.fsync(self.file.fileno())

    def close(self) -> None:
        self.file.close()


def file_hash(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def copy_no_replace(source: str, target: str) -> bool:
    """Copies a file whole or not at all: to a hidden name first, then under its own; False if the target is taken."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    if os.path.exists(target):
        return False
    part = os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.{os.getpid()}.partial")
    shutil.copy2(source, part)
    try:
        os.link(part, target)
    except FileExistsError:
        return False
    except OSError:
        if os.path.exists(target):
            return False
        os.rename(part, target)
        return True
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return True


def place(rows: Iterator, staged: str, library: str, journal: Journal) -> int:
    """Puts staged files where the plan (id, sha, path, year, name) says; how many were put.

    Intent goes to the journal first. A file counts as placed only if its own bytes are at its path: put there now,
    or by an earlier run. Where another file has the path, the staged one stays and the journal names the error.
    """
    n = 0
    for r in rows:
        journal.put(id=r.id, sha=r.sha, stage="placing", path=r.path, year=r.year, name=r.name)
        source, target = os.path.join(staged, r.sha), os.path.join(library, r.path)
        put = os.path.exists(source) and put_no_replace(source, target)
        n += put
        if put or (os.path.exists(target) and file_hash(target) == r.sha):
            if os.path.exists(source):
                os.unlink(source)
            journal.put(id=r.id, sha=r.sha, stage="placed", path=r.path, year=r.year, name=r.name)
        else:
            error = "another file has this path" if os.path.exists(target) else "the staged file is missing"
            journal.put(id=r.id, sha=r.sha, stage="placing", path=r.path, year=r.year, name=r.name, error=error)
    return n


def clone_albums(rows: Iterator, library: str, journal: Journal) -> int:
    """Copies placed files (id, sha, path, albums: target paths) into their albums; how many copies were made. A file is cloned once its own bytes are in every album."""
    n = 0
    for r in rows:
        own, taken = os.path.join(library, r.path), []
        for album in r.albums:
            target = os.path.join(library, album)
            if os.path.exists(own) and copy_no_replace(own, target):
                n += 1
            elif not os.path.exists(target) or not os.path.exists(own) or file_hash(target) != file_hash(own):
                taken.append(album)
        if taken:
            journal.put(id=r.id, sha=r.sha, stage="placed", path=r.path, albums=list(r.albums), error=f"not cloned: {taken[0]}")
        else:
            journal.put(id=r.id, sha=r.sha, stage="cloned", path=r.path, albums=list(r.albums))
    return n


def write_report(report: DataFrame, folder: str, cap: int = 200) -> dict:
    """report.json and report.txt of a report in long form (metric, key, value), which is small by nature."""
    out: dict = {}
    for r in report.collect():
        out.setdefault(r.metric, {})[r.key] = r.value
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "report.json"), "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False, indent=1, sort_keys=True)
    with open(os.path.join(folder, "report.txt"), "w", encoding="utf-8") as f:
        for metric in sorted(out):
            lines = [f"  {k}: {v}" for k, v in sorted(out[metric].items())]
            f.write("\n".join([metric, *lines[:cap], *([f"  and {len(lines) - cap} more"] if len(lines) > cap else [])]) + "\n")
    return out
