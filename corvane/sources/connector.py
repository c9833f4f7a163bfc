"""A named data source for file listings: files are dealt to tasks by size and hashed in blocks."""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from corvane.sources.files import sha256_of

TASKS = 64  # tasks that a listing is dealt to, unless the option says otherwise


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, float, int]]) -> None:
        super().__init__(len(files))
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.extensions = tuple(e for e in options.get("extensions", ".md,.txt").split(",") if e)
        self.label = options.get("label", "")
        self.tasks = int(options.get("tasks", TASKS))

    def partitions(self):
        from pyarrow import fs

        found = []
        for root in self.paths:
            files, name = (fs.LocalFileSystem(), re.sub("^file:/*", "/", root)) if re.match("/|file:", root) else fs.FileSystem.from_uri(root)
            info = files.get_file_info(name)
            below = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(name, recursive=True))
            scheme = "" if isinstance(files, fs.LocalFileSystem) else f"{root.partition('://')[0]}://"
            found += [(scheme + f.path, f.mtime.timestamp(), f.size) for f in below if f.type == fs.FileType.File and f.path.endswith(self.extensions)]
        # the largest first, each to the task that has the least so far: no folder and no large file decides the number of tasks
        dealt: list[list] = [[] for _ in range(max(1, min(self.tasks, len(found))))]
        loads = [(0, i) for i in range(len(dealt))]
        for file in sorted(found, key=lambda f: (-f[2], f[0])):
            load, i = heapq.heappop(loads)
            dealt[i].append(file)
            heapq.heappush(loads, (load + file[2] + 1, i))
        return [_Files(d) for d in dealt]

    def read(self, partition):
        for name, mtime, size in partition.files:
            uri = Path(os.path.normpath(name)).as_uri() if name.startswith("/") else name
            yield (uri, self.label, sha256_of(name), mtime, size)


class FileListing(DataSource):
    """``spark.read.format("corvane_files").option("paths", "a,b").option("extensions", ".md")``."""

    @classmethod
    def name(cls):
        return "corvane_files"

    def schema(self):
        return "uri string, label string, content_hash string, mtime double, size long"

    def reader(self, schema):
        return _Reader(self.options)


class _PulseReader(SimpleDataSourceStreamReader):
    """Emits one row whenever the names, sizes or times below the roots changed.

    The offset is a digest of the listing, so it stays small however many files there are, and
    created, modified and deleted files all move it. What changed is for the reconcile to find.
    """

    def __init__(self, options) -> None:
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.extensions = tuple(e.lower() for e in options.get("extensions", ".md,.txt").split(",") if e)

    def _digest(self) -> str:
        digest = hashlib.sha256()
        for root in self.paths:
            for folder, folders, files in os.walk(root):
                folders.sort()
                for name in sorted(files):
                    if name.lower().endswith(self.extensions):
                        stat = os.stat(os.path.join(folder, name))
                        digest.update(f"{folder}/{name}|{stat.st_size}|{stat.st_mtime_ns}\n".encode())
        return digest.hexdigest()

    def initialOffset(self):
        return {"pulse": 0, "digest": ""}

    def read(self, start):
        now = self._digest()
        if now == start["digest"]:
            return iter(()), start
        end = {"pulse": start["pulse"] + 1, "digest": now}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start, end):
        return iter([(end["pulse"], end["digest"])] if end["pulse"] > start["pulse"] else [])

    def commit(self, end):
        pass


class ListingPulse(DataSource):
    """A stream with one row per burst of file changes below ``paths``."""

    @classmethod
    def name(cls):
        return "corvane_pulse"

    def schema(self):
        return "pulse long, digest string"

    def simpleStreamReader(self, schema):
        return _PulseReader(self.options)
