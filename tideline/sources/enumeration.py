"""A streaming source that enumerates media files by (modified time, path) and goes on where it stopped.

Spark keeps the offset of each batch in the query's checkpoint; a restarted stream asks for exactly the batches that are
not done, and lists them anew between the same two offsets. An offset is a time and a path, so that files of equal times
at the mark are neither lost nor repeated. A batch ends before what may still change: only files that are `settle` seconds
old are taken, as later ones may yet be joined by others of the same time.
"""

from __future__ import annotations

import datetime
import posixpath
import time

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tideline.sources.files import IMAGE_TYPES, VIDEO_TYPES

SCHEMA = "path string, relative string, album string, mime string, size long, modified timestamp"


def listed(root: str, below: str | None = None, deep: bool = True):
    """(modified in microseconds, relative path, size) of media files, hidden ones left out; through Arrow's file systems."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + posixpath.abspath(root))
    start = base if below is None else posixpath.join(base, below)
    for info in system.get_file_info(fs.FileSelector(start, allow_not_found=True, recursive=deep)):
        relative = posixpath.relpath(info.path, base)
        ending = relative.rpartition(".")[2].lower()
        if info.type == fs.FileType.File and ending in IMAGE_TYPES | VIDEO_TYPES and not any(p.startswith(".") for p in relative.split("/")):
            yield info.mtime_ns // 1_000, relative, info.size


def folders(root: str) -> list[str]:
    """First-level folders, hidden ones left out."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + posixpath.abspath(root))
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(i.base_name for i in found if i.type == fs.FileType.Directory and not i.base_name.startswith("."))


class Part(InputPartition):
    """One folder (None: the files beside the folders) between two marks."""

    def __init__(self, folder: str | None, start: tuple, end: tuple):
        self.folder, self.start, self.end = folder, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.settle = options["path"].rstrip("/"), float(options.get("settle", "2"))

    def initialOffset(self) -> dict:
        return {"us": -1, "path": ""}

    def latestOffset(self) -> dict:
        """The greatest mark of files that have settled. Folders are listed one by one; only the mark stays."""
        until, best = int((time.time() - self.settle) * 1_000_000), (-1, "")
        for folder in [None, *folders(self.root)]:
            for us, path, _ in listed(self.root, folder, deep=folder is not None):
                if us <= until:
                    best = max(best, (us, path))
        return {"us": best[0], "path": best[1]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        marks = (start["us"], start["path"]), (end["us"], end["path"])
        return [Part(f, *marks) for f in [None, *folders(self.root)]]

    def read(self, part: Part):
        for us, path, size in listed(self.root, part.folder, deep=part.folder is not None):
            if part.start < (us, path) <= part.end:
                ending = path.rpartition(".")[2].lower()
                when = datetime.datetime.fromtimestamp(us // 1_000_000, datetime.UTC).replace(microsecond=us % 1_000_000)
                yield f"{self.root}/{path}", path, part.folder, (IMAGE_TYPES | VIDEO_TYPES)[ending], size, when

    def commit(self, end: dict) -> None:
        """Nothing to release: files stay where they are."""


class MediaFiles(DataSource):
    """spark.dataSource.register(MediaFiles); spark.readStream.format("media_files").option("path", root).load()

    Options: path, a folder that all hosts see; settle, the seconds after which a file no longer changes.
    """

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)
