"""A folder tree as a data source: files of every name, listed by subtrees on the executors.

    folder.register(spark)
    spark.read.format("folder_tree").option("recursive", "true").load("/some/folder")

Spark's own file readers hide what begins with . or _; this one lists all regular files.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "folder_tree"
SCHEMA = "path string, relative string, size_bytes bigint, modified timestamp"
#: Files of a batch that a reader passes on.
BATCH = 10_000


def open_tree(uri: str):
    """The pyarrow file system of a folder and the folder's path in it."""
    from pyarrow import fs

    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")


def prefix_of(uri: str) -> str:
    """What stands before a file system's own path in a full path."""
    return uri[: uri.index("/", uri.index("://") + 3)] if "://" in uri and not uri.startswith("file:") else "file:"


def children(system, at: str) -> list:
    from pyarrow import fs

    return sorted(system.get_file_info(fs.FileSelector(at, recursive=False, allow_not_found=True)), key=lambda i: i.path)


@dataclass
class Subtree(InputPartition):
    """Folders to walk, and files that planning met on its way."""

    folders: tuple[str, ...]
    files: tuple[tuple[str, int, int], ...] = ()

    def __post_init__(self):
        super().__init__(self.folders)


class TreeReader(DataSourceReader):
    def __init__(self, uri: str, recursive: bool, subtrees: int):
        self.uri, self.recursive, self.subtrees = uri, recursive, subtrees

    def partitions(self) -> list[InputPartition]:
        """The folder is opened level by level until there are ``subtrees`` folders to deal out; only these levels are listed here."""
        from pyarrow import fs

        system, root = open_tree(self.uri)
        if system.get_file_info(root).type != fs.FileType.Directory:
            raise ValueError(f"{self.uri} is not a folder")
        left, files = deque([root]), []
        while left and len(left) < self.subtrees:
            for i in children(system, left.popleft()):
                if i.type == fs.FileType.Directory and self.recursive:
                    left.append(i.path)
                elif i.type == fs.FileType.File:
                    files.append((i.path, i.size, i.mtime_ns // 1000))
        parts = [Subtree((f,)) for f in left]
        parts += [Subtree((), tuple(files[k : k + BATCH])) for k in range(0, len(files), BATCH)]
        return parts or [Subtree(())]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = open_tree(self.uri)
        before, cut = prefix_of(self.uri), len(root.rstrip("/")) + 1

        def batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
            path, size, time = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([before + p for p in path]), pa.array([p[cut:] for p in path]), pa.array(size, pa.int64()), pa.array(time, pa.int64()).cast(pa.timestamp("us", "UTC"))], ["path", "relative", "size_bytes", "modified"])

        rows, left = list(partition.files), list(partition.folders)
        while left:
            for i in children(system, left.pop()):
                if i.type == fs.FileType.Directory:
                    left.append(i.path)
                elif i.type == fs.FileType.File:
                    rows.append((i.path, i.size, i.mtime_ns // 1000))
            if len(rows) >= BATCH:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


class TreeSource(DataSource):
    """Options: path; recursive (false: direct children only); subtrees (512), folders that are dealt to tasks."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return TreeReader(o["path"], o.get("recursive", "false").lower() == "true", int(o.get("subtrees", 512)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def contents(batches: Iterator[pa.RecordBatch], uri: str, most: int) -> Iterator[pa.RecordBatch]:
    """``content`` beside the columns of each row's ``path``, about ``most`` bytes a batch; null where a file is gone or larger than ``most``."""
    system, _ = open_tree(uri)
    before = len(prefix_of(uri))
    for b in batches:
        held, size, first = [], 0, 0
        for k, (path, n) in enumerate(zip(b.column("path").to_pylist(), b.column("size_bytes").to_pylist(), strict=True)):
            if held and size + n > most:
                yield pa.RecordBatch.from_arrays([*b.slice(first, len(held)).columns, pa.array(held, pa.binary())], [*b.schema.names, "content"])
                held, size, first = [], 0, k
            try:
                if n > most:
                    held.append(None)
                else:
                    with system.open_input_stream(path[before:]) as f:
                        held.append(f.read())
            except FileNotFoundError:
                held.append(None)
            size += n
        if held:
            yield pa.RecordBatch.from_arrays([*b.slice(first, len(held)).columns, pa.array(held, pa.binary())], [*b.schema.names, "content"])
