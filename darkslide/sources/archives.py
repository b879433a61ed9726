"""Zip archives as tables: their directories, and the bodies of chosen entries.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archives").option("path", folder).load()                       # directory rows only
    spark.read.format("archives").option("path", folder).option("mode", "content").option("suffix", ".json").load()

One partition per archive. The directory mode never touches a body; the content mode reads the entries whose name
ends in `suffix`, hashes them whole, and keeps a body only up to `max_bytes`. What cannot be read is a row with an
error, not a failed task.
"""

from __future__ import annotations

import hashlib
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

INDEX_SCHEMA = "zip_path string, zip_ord int, entry_ord int, entry_name string, size bigint, crc32 bigint, is_symlink boolean"
CONTENT_SCHEMA = "zip_path string, zip_ord int, entry_ord int, entry_name string, size bigint, sha256 string, content binary, error string"
MAX_BYTES = 16 * 1024 * 1024


def list_archives(folder: str) -> list[str]:
    """The zip files of a folder, any case, not of its subfolders, by path. Brackets in names mean nothing."""
    return sorted(e.path for e in os.scandir(folder) if e.is_file() and e.name.lower().endswith(".zip"))


class ArchivePartition(InputPartition):
    def __init__(self, path: str, order: int):
        super().__init__((path, order))
        self.path, self.order = path, order


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.content = options.get("mode", "index") == "content"
        self.suffix = options.get("suffix", "").lower()
        self.limit = int(options.get("max_bytes", MAX_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [ArchivePartition(p, i) for i, p in enumerate(list_archives(self.folder))]

    def read(self, partition: ArchivePartition) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(partition.path)
        except (OSError, zipfile.BadZipFile) as e:
            if self.content:
                yield partition.path, partition.order, -1, None, None, None, None, f"{type(e).__name__}: {e}"[:300]
                return
            raise RuntimeError(f"{partition.path} cannot be opened; fetch it again if it is not whole: {e}") from e
        with archive as z:
            for i, info in enumerate(x for x in z.infolist() if not x.is_dir()):
                if not self.content:
                    link = (info.external_attr >> 16) & 0o170000 == 0o120000
                    yield partition.path, partition.order, i, info.filename, info.file_size, info.CRC, link
                elif info.filename.lower().endswith(self.suffix):
                    yield (partition.path, partition.order, i, info.filename, info.file_size, *self._body(z, info))

    def _body(self, z: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[str | None, bytes | None, str | None]:
        digest, kept = hashlib.sha256(), bytearray()
        try:
            with z.open(info) as f:
                while block := f.read(1 << 20):
                    digest.update(block)
                    if info.file_size <= self.limit:
                        kept += block
        except Exception as e:  # a damaged entry is data about the archive
            return None, None, f"{type(e).__name__}: {e}"[:300]
        return digest.hexdigest(), bytes(kept) if info.file_size <= self.limit else None, None


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return CONTENT_SCHEMA if self.options.get("mode", "index") == "content" else INDEX_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def hashes(entries: DataFrame) -> DataFrame:
    """(id, content_hash) of entries (id, zip_path, entry_ord, entry_name), hashed whole where they lie. What cannot be read has a hash of its place, after a `~`."""

    def one(z: zipfile.ZipFile, path: str, info: zipfile.ZipInfo, name: str) -> str:
        digest = hashlib.sha256()
        try:
            with z.open(info) as f:
                while block := f.read(1 << 20):
                    digest.update(block)
        except Exception:  # a damaged entry is data about the archive
            return "~" + hashlib.sha256(f"unreadable:{path}\0{name}".encode()).hexdigest()
        return digest.hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, group in b.groupby("zip_path"):
                with zipfile.ZipFile(path) as z:
                    infos = [x for x in z.infolist() if not x.is_dir()]
                    rows += [(i, one(z, path, infos[n], name)) for i, n, name in zip(group["id"], group["entry_ord"], group["entry_name"])]
            yield pd.DataFrame(rows, columns=["id", "content_hash"])

    return entries.select("id", "zip_path", "entry_ord", "entry_name").mapInPandas(run, "id string, content_hash string")


def heads(entries: DataFrame, size: int = 32, reach: int = 262_144) -> DataFrame:
    """(id, head, motion) of entries (id, zip_path, entry_ord): the first bytes of each, and whether the marker of a motion photo lies within reach. What cannot be read has neither."""

    def one(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, bool]:
        try:
            with z.open(info) as f:
                body = f.read(reach)
        except Exception:  # a damaged entry is data about the archive
            return None, False
        return body[:size], b"MotionPhoto" in body

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, group in b.groupby("zip_path"):
                with zipfile.ZipFile(path) as z:
                    infos = [x for x in z.infolist() if not x.is_dir()]
                    rows += [(i, *one(z, infos[n])) for i, n in zip(group["id"], group["entry_ord"])]
            yield pd.DataFrame(rows, columns=["id", "head", "motion"])

    return entries.select("id", "zip_path", "entry_ord").mapInPandas(run, "id string, head binary, motion boolean")
