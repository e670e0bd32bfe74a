"""Continuous ingestion: units arrive as files, chunks are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk


def stream_chunks(spark: SparkSession, source: str, schema: str, *, max_chars: int = 6000, watermark: str = "1 hour") -> DataFrame:
    """Chunks of the units that arrive under ``source`` (with an event time ``at``), each id once within the watermark."""
    units = spark.readStream.schema(schema).parquet(source)
    fresh = units.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["raw_hash", "tool_profile_hash", "gen", "unit_key"])
    return chunk(fresh, max_chars)


def append_chunks(chunks: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append to ``target`` what is there now, chunk ids that the table has left out, and end."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["chunk_id"])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            rows = rows.join(spark.read.schema("chunk_id string").parquet(target), "chunk_id", "left_anti")
        rows.write.mode("append").parquet(target)

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
