"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows, and bytes of its columns together, of the part of an Arrow batch that is worked on at once.
PART_ROWS, PART_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sievelight-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sievelight/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it: lineage ends here, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that no later plan reads."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows and bytes (at least one row), since rows hold whole texts."""
    for b in batches:
        rows = max(1, min(PART_ROWS, PART_BYTES * b.num_rows // max(1, b.nbytes)))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5; rows of remainder 0 are held out. Null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def unit_interval(salt: str, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys only: 52 bits of their MD5."""
    text = F.concat(F.lit(salt), *[F.concat(F.lit(":"), F.coalesce(k.cast("string"), F.lit("null"))) for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def null_safe(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of all the named columns, null being equal to null."""
    cond = left[names[0]].eqNullSafe(right[names[0]])
    for n in names[1:]:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def open_folder(uri: str):
    """A pyarrow file system and the path in it, for a folder that executors reach by themselves."""
    from pyarrow import fs

    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    path = uri.removeprefix("file:")
    return fs.LocalFileSystem(), "/" + path.lstrip("/")


_kept: dict[tuple, object] = {}


def keep(key: tuple, make):
    """In a Python worker: what ``make`` gave for ``key``, kept between tasks until another operator's task begins."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def drop_kept() -> None:
    _kept.clear()
