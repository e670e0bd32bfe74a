"""A corpus of any size for timing: scopes, files and sections from a range of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scale_units(spark: SparkSession, scopes: int = 20, files: int = 200, sections: int = 30) -> DataFrame:
    """Markdown units, one per file; each section has a heading, a twelve-digit reference of its own and some words."""
    rows = spark.range(scopes * files).select((F.col("id") % scopes).alias("scope"), F.floor(F.col("id") / scopes).alias("file"))
    ref = lambda k: F.substring(F.sha2(F.concat_ws(":", F.col("scope"), F.col("file"), k), 256), 1, 12)
    part = lambda k: F.concat(F.lit("# Section "), k.cast("string"), F.lit("\n\nReference "), ref(k), F.lit(" of file "), F.col("file").cast("string"), F.lit(" and section "), k.cast("string"), F.lit(".\n\n"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(sections)), part), "")
    key = F.concat(F.lit("file:"), F.col("file").cast("string"))
    return rows.select(F.concat(F.lit("scope-"), F.col("scope").cast("string")).alias("scope_id"), F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("raw_hash"), F.lit("fixture").alias("tool_profile_hash"), F.lit(1).cast("bigint").alias("gen"), key.alias("unit_key"), text.alias("text"))


def attest(chunks: DataFrame, expected: int) -> DataFrame:
    """One row: chunks, distinct ids, and whether both are as expected."""
    n = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("chunk_id").alias("ids"))
    return n.withColumn("ready", (F.col("chunks") == expected) & (F.col("ids") == expected))
