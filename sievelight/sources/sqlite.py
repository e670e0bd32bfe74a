"""SQLite files as sources: rows of a query on an immutable copy."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import content_hash


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str, *, expected: str | None = None, rows: int = 10_000) -> DataFrame:
    """The rows of ``query`` on every database file that ``path`` names, after the file's own path.

    A task takes a file's bytes once and opens them in memory, so that a writer that goes on
    changes nothing, and no lock is asked for; what is in a write-ahead log beside the file is
    not seen. With ``expected`` bytes of another hash are an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content", content_hash(F.col("content")).alias("hash"))
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content, found in zip(b["path"], b["content"], b["hash"], strict=True):
                if expected is not None and found != expected:
                    raise ValueError(f"{name} has changed: {found}")
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                db.execute("pragma query_only = on")
                cursor = db.execute(query)
                while got := cursor.fetchmany(rows):
                    yield pd.DataFrame(got, columns=names).assign(path=name)[["path", *names]]
                db.close()

    return files.mapInPandas(run, f"path string, {schema}")
