"""A streaming source of new and modified files (STR-4).

Spark's own file source knows a path once, so what changes later is never seen. This one's offset is a time: a batch holds the files that were modified after the last offset and up to the next. The driver lists names and
times; contents are read by the tasks, so many files are read side by side, in any store that Arrow knows.

A file is taken when its last change is settle_ms old, so that no later change can have a time that was already passed. It is read as it is then: if it has changed since the batch was planned, its row is left to the batch
of the later change; if it is gone, there is no row. A file that changes twice between two listings is seen once, as it was last. Files that come with old times (moved with times kept) aren't seen. Bytes that aren't
UTF-8 are replacement characters. A folder that isn't there has no files.
"""

from __future__ import annotations

import fnmatch
import os
import re
import sys
import time
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

SETTLE_MS, FILES_PER_TASK = 100, 200


def store_of(folder: str) -> tuple[Any, str]:
    """The store of a folder (a path or an address) and the folder's place in it. As in Spark's paths, spaces and percent signs of an address of this machine's disk stand for themselves."""
    from pyarrow import fs

    if not re.match(r"[A-Za-z][\w+.-]*:/", folder):
        return fs.LocalFileSystem(), os.path.abspath(folder)
    if local := re.match(r"file:(?://)?(/[^/].*|/)$", folder, re.DOTALL):
        return fs.LocalFileSystem(), local[1].rstrip("/")
    store, root = fs.FileSystem.from_uri(folder)
    return store, root.rstrip("/")


def listed(folder: str, pattern: str, after: int, until: int) -> list[tuple[str, int]]:
    """(name below the folder, time in nanoseconds) of the files modified after one time and up to another, oldest first; pattern is for a file's own name."""
    from pyarrow import fs

    store, root = store_of(folder)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    files = [(f.path[len(root) + 1 :], f.mtime_ns) for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern)]
    return sorted((f for f in files if after < f[1] <= until), key=lambda f: (f[1], f[0]))


def planned(files: list[tuple[str, int]], most: int) -> list[list[tuple[str, int]]]:
    """files in parts of so many."""
    return [files[i : i + most] for i in range(0, len(files), most)]


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Changes(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, settle_ms: int, most: int):
        self.folder, self.pattern, self.settle_ms, self.most = folder, pattern, settle_ms, most
        self.seen = 0
        self.found: tuple[int, list[tuple[str, int]]] = (0, [])  # where the last listing with files began, and what it found

    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return {"until": 0}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        """The time of the last change that has settled; it never goes back, even where files are deleted."""
        files = listed(self.folder, self.pattern, self.seen, time.time_ns() - self.settle_ms * 1_000_000)
        if files:
            self.found = (self.seen, files)
        self.seen = max(self.seen, files[-1][1] if files else 0)
        return {"until": self.seen}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> Sequence[InputPartition]:
        self.seen = max(self.seen, end["until"])
        after, files = self.found
        if (after, files[-1][1] if files else 0) != (start["until"], end["until"]):  # not the batch that was found last, as after a start from a checkpoint
            files = listed(self.folder, self.pattern, start["until"], end["until"])
        return [_Files(part) for part in planned(files, self.most)]

    def read(self, partition: Any) -> Iterator[tuple[Any, ...]]:
        import datetime

        store, root = store_of(self.folder)
        for name, modified in partition.files:
            path = f"{root}/{name}"
            try:
                with store.open_input_stream(path) as f:
                    content = f.read()
                if store.get_file_info(path).mtime_ns != modified:
                    continue
            except FileNotFoundError:
                continue
            at = datetime.datetime.fromtimestamp(modified // 1_000_000 / 1000, datetime.timezone.utc)
            yield path, name, content.decode("utf-8", "replace"), at


class ChangedFiles(DataSource):
    """Format notemill_changes; options folder, pattern, settle_ms and files_per_task."""

    @classmethod
    def name(cls) -> str:
        return "notemill_changes"

    def schema(self) -> str:
        return "path string, name string, content string, modified timestamp"

    def streamReader(self, schema: Any) -> DataSourceStreamReader:  # noqa: N802
        o = self.options
        return _Changes(o["folder"], o.get("pattern", "*"), int(o.get("settle_ms", SETTLE_MS)), int(o.get("files_per_task", FILES_PER_TASK)))
