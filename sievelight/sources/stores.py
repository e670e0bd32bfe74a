"""Tables that stand for stores: content-addressed objects, logs, registries and projections."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import content_hash


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that operators write, below ``spark.checkpoint.dir``; a local one only where that is unset in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sievelight-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sievelight"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its path type."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(context._jsc.hadoopConfiguration()), at


def read_file(spark: SparkSession, path: str) -> bytes:
    """A small file as it is."""
    fs, at = file_system(spark, path)
    stream = fs.open(at(path))
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write_new_file(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a small file that does not exist yet; False if it does."""
    fs, at = file_system(spark, path)
    if fs.exists(at(path)):
        return False
    try:
        stream = fs.create(at(path), False)
    except Exception as e:
        if fs.exists(at(path)):
            return False  # another writer was first
        raise e
    stream.write(data)
    stream.close()
    return True


def read_version(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version (the latest) of what lies below ``path``; None where there is none. One whose writer is not done, or died, does not count."""
    fs, at = file_system(spark, path)
    folder = at(f"{path}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    versions = sorted((int(n) for n in names if n.isdigit()), reverse=True)
    for v in versions if version is None else [version]:
        text = read_file(spark, f"{path}/manifests/{v:012d}").decode()
        if text.endswith("\n"):
            return json.loads(text)
    if version is not None or versions:
        raise ValueError(f"no whole version {version if version is not None else versions} of {path}")
    return None


def publish_version(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write the manifest of a new version (``manifest["version"]``); an error if another writer was first."""
    if not write_new_file(spark, f"{path}/manifests/{manifest['version']:012d}", (json.dumps(manifest) + "\n").encode()):
        raise RuntimeError(f"{path} already has version {manifest['version']}: open it and try again")


def written(df: DataFrame) -> DataFrame:
    """``df``, written below the shared folder and read back: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for tables that no later plan reads."""
    for t in tables:
        fs, at = file_system(t.sparkSession, t.written_to)
        fs.delete(at(t.written_to), True)


def new_objects(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Objects (kind, body) keyed by content that the store does not have yet, once each."""
    keyed = rows.withColumn("hash", content_hash(F.col("body").cast("binary"))).dropDuplicates(["kind", "hash"])
    return keyed.join(stored.select("kind", "hash"), ["kind", "hash"], "left_anti")


def latest(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last record of each key of an append-only log."""
    last = log.groupBy(*key).agg(F.max_by(F.struct(*log.columns), F.col(order)).alias("last"))
    return last.select("last.*")


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with ``rows`` put in or in place; of several rows of one key the last by ``seq`` counts."""
    both = table.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(rows)
    nth = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("seq")))
    return both.withColumn("_n", nth).where("_n = 1").drop("_n", "seq")


def replace_scope(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Overwrite only the scopes that ``rows`` has, in a table partitioned by scope."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope_id").parquet(path)


def retain_scopes(table: DataFrame, live: DataFrame) -> DataFrame:
    return table.join(live.select("scope_id").distinct(), "scope_id", "left_semi")


def write_embeddings(contents: DataFrame, rows: DataFrame, *, width: int | None = None) -> DataFrame:
    """Content rows (target_hash, profile_hash, context, vector) with ``rows`` (and seq) put in or in place.

    The key is hash, profile and context, null being a context of its own; of several rows of one key the last by seq
    counts, so writing rows again changes nothing. A vector that is null, empty, not finite, of
    norm zero, or not of ``width`` is an error. ``link_embeddings`` then finds the vectors of chunks.
    """
    v = F.col("vector")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)
    fine = fine if width is None else fine & (F.size(v) == width)
    checked = rows.withColumn("vector", F.when(F.coalesce(fine, F.lit(False)), v).otherwise(F.raise_error(F.concat(F.lit("no vector to store for "), F.col("target_hash"))).cast(rows.schema["vector"].dataType)))
    return upsert(contents, checked, ["target_hash", "profile_hash", "context"])


def link_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vectors of chunks by text hash, profile and context (null equals null); more than one is an error."""
    on = (chunks["text_hash"] == embeddings["target_hash"]) & (chunks["profile_hash"] == embeddings["profile_hash"]) & chunks["context"].eqNullSafe(embeddings["context"])
    linked = chunks.join(embeddings.select("target_hash", "profile_hash", "context", "vector"), on, "left").drop(embeddings["target_hash"]).drop(embeddings["profile_hash"]).drop(embeddings["context"])
    n = F.count("vector").over(W.partitionBy("scope_id", "chunk_id"))
    checked = linked.withColumn("_n", n).withColumn("vector", F.when(F.col("_n") > 1, F.raise_error(F.lit("a chunk has two embeddings")).cast("array<float>")).otherwise(F.col("vector")))
    return checked.drop("_n")


def append_log(rows: DataFrame, path: str) -> None:
    """Add records to a JSON Lines log; nulls are written, so that a replay sees every column."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON Lines log with a fixed schema; a record that breaks it is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def rewrite_log(spark: SparkSession, path: str, schema: str, keep) -> int:
    """Keep the records of a log for which the condition ``keep`` holds; returns how many went.

    What stays is written aside and moved into place, so that a reader sees the old log or the new one.
    """
    log = read_log(spark, path, schema)
    before, kept = log.count(), log.where(keep)
    aside, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    kept.write.mode("overwrite").option("ignoreNullFields", "false").json(aside)
    context = spark.sparkContext
    at = lambda p: context._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(context._jsc.hadoopConfiguration())
    left = read_log(spark, aside, schema).count()
    fs.delete(at(old), True)
    if not fs.rename(at(path), at(old)) or not fs.rename(at(aside), at(path)):
        raise OSError(f"the log could not be moved: {path}")
    fs.delete(at(old), True)
    return before - left


def search_targets(registry: DataFrame) -> DataFrame:
    """Scopes to search: the entry seen last of each scope, if it is searchable and its path holds no scope seen later."""
    last = latest(registry, ["scope_id"], "seen")
    owner = last.groupBy("path").agg(F.max(F.struct("seen", "scope_id")).alias("o")).select("path", F.col("o.scope_id").alias("scope_id"))
    return last.join(owner, ["path", "scope_id"], "left_semi").where("searchable")


def removed(registry: DataFrame, gone: DataFrame) -> DataFrame:
    """The registry without the scopes of ``gone``."""
    return registry.join(gone.select("scope_id").distinct(), "scope_id", "left_anti")


def duplicates(registry: DataFrame) -> DataFrame:
    """Scopes that several paths claim, with their number."""
    return registry.groupBy("scope_id").agg(F.count_distinct("path").alias("paths")).where("paths > 1")


def high_water(rows: DataFrame, by: list[str], row: str) -> DataFrame:
    """Per group the number of rows, of profiles, and the largest row id (0 without rows)."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("profile_hash").alias("profiles"), F.coalesce(F.max(row), F.lit(0)).alias("high_water"))


def generation(headers: DataFrame) -> DataFrame:
    """One hash of all scope headers (scope_id, n, size) in the order of their ids."""
    line = F.concat("scope_id", F.lit("\t"), F.col("n").cast("string"), F.lit("\t"), F.col("size").cast("string"), F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("scope_id", line.alias("line")))), lambda x: x["line"])  # a line a scope
    return headers.agg(content_hash(F.array_join(lines, "")).alias("generation"))


def view_offsets(units: DataFrame) -> DataFrame:
    """Where each unit (doc, ord, text) starts and ends in its document's view, in bytes."""
    w = W.partitionBy("doc").orderBy("ord")
    rows = units.withColumn("_n", F.octet_length("text").cast("bigint"))
    start = F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("byte_start", start).withColumn("byte_end", F.col("byte_start") + F.coalesce("_n", F.lit(0))).drop("_n")
