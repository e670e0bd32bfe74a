"""A sink for objects: a new folder that appears whole, or not at all."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .folder import open_tree

FORMAT = "new_folder"
SAFE = re.compile(r"[^/\\\0]+")


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class FolderWriter(DataSourceArrowWriter):
    """Tasks write beside the target and move each file into the staging folder whole; the commit moves that folder into place."""

    def __init__(self, target: str, most_bytes: int):
        self.target, self.most_bytes = target.rstrip("/"), most_bytes
        head, _, name = self.target.rpartition("/")
        self.staging = f"{head}/.{name}.{uuid.uuid4().hex}"
        system, at = open_tree(self.staging)
        system.create_dir(at, recursive=True)  # here alone: a task that outlives an abort must not make it again

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, at = open_tree(self.staging)
        names = []
        for b in batches:
            for name, want, body in zip(b.column("name").to_pylist(), b.column("hash").to_pylist(), b.column("body").to_pylist(), strict=True):
                if name is None or not SAFE.fullmatch(name) or name in (".", "..") or name.startswith(".part-"):
                    raise ValueError(f"unsafe name: {name}")
                if body is None or f"sha256:{hashlib.sha256(body).hexdigest()}" != want:
                    raise ValueError(f"{name} does not have the hash {want}")
                if len(body) > self.most_bytes:
                    raise ValueError(f"{name} has {len(body)} bytes; {self.most_bytes} are allowed")
                part = f"{at}/.part-{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(body)
                system.move(part, f"{at}/{name}")  # what an attempt that failed has left is the same object
                names.append(name)
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        names = [n for m in messages if m is not None for n in m.names]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError(f"a name is there twice: {next(n for n in names if names.count(n) > 1)}")
        system, at = open_tree(self.staging)
        _, target = open_tree(self.target)
        for i in system.get_file_info(fs.FileSelector(at)):  # parts of attempts that died
            if i.base_name not in set(names):
                system.delete_file(i.path)
        if system.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"{self.target} exists")
        system.move(at, target)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, at = open_tree(self.staging)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


class NewFolder(DataSource):
    """Options: path; most_bytes, of one object."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, hash string, body binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FolderWriter(self.options["path"], int(self.options.get("most_bytes", 1 << 30)))


def restore(objects: DataFrame, folder: str, *, most_bytes: int = 1 << 30) -> DataFrame:
    """Write objects (hash, name, body) as files of a new folder that executors share; returns name and size_bytes.

    The folder appears when all objects are in it: it must not exist, and nothing is left if an
    object lacks its hash, is larger than ``most_bytes``, or has an unsafe name or one that another has. Tasks
    that are run again, after an executor is lost, write the same files once more.
    """
    spark: SparkSession = objects.sparkSession
    spark.dataSource.register(NewFolder)
    rows = objects.selectExpr("cast(name as string) name", "cast(hash as string) hash", "cast(body as binary) body")
    rows.write.format(FORMAT).option("most_bytes", str(most_bytes)).mode("append").save(folder)
    return rows.selectExpr("name", "cast(octet_length(body) as bigint) size_bytes")
