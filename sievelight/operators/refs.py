"""Names of commits: tags, resolution, inspection; retained instances and reindexing of the past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collision_key_col
from .chunking import chunk
from .history import diff

HASH = r"^sha256:[0-9a-f]{64}$"


def operand_fault(name: Column) -> Column:
    """Why a text cannot name a commit or tag: empty, or with path parts; null if it can."""
    return F.when(F.length(name) == 0, "empty").when(name.rlike(r"[/\\\x00]") | name.isin(".", ".."), "path")


def tag(wanted: DataFrame, tags: DataFrame, commits: DataFrame, head: str) -> DataFrame:
    """What becomes of wishes for tags (name, commit; null is the head): commit_hash of new tags, or a fault.

    Names that fold to HEAD or look like a hash would never be found and are refused, as are
    those that differ from a tag in case only, and commits that are not there.
    """
    w = wanted.withColumn("commit_hash", F.coalesce("commit", F.lit(head))).withColumn("key", collision_key_col("name"))
    taken = tags.select(collision_key_col("name").alias("key")).distinct().withColumn("_taken", F.lit(True))
    there = commits.select("commit_hash").distinct().withColumn("_there", F.lit(True))
    rows = w.join(taken, "key", "left").join(there, "commit_hash", "left")
    fault = F.coalesce(operand_fault(F.col("name")), F.when((F.col("key") == "head") | F.col("key").rlike(HASH), "reserved").when(F.col("_there").isNull(), "commit_missing").when(F.col("_taken"), "exists"))
    return rows.withColumn("fault", fault).select("name", F.when(F.col("fault").isNull(), F.col("commit_hash")).alias("commit_hash"), "fault")


def resolve(operands: DataFrame, tags: DataFrame, commits: DataFrame, head: str) -> DataFrame:
    """The commit that each operand names: HEAD, a hash, or a tag whatever its case; or a fault."""
    t = tags.select(collision_key_col("name").alias("key"), F.col("commit_hash").alias("tagged"))
    rows = operands.withColumn("key", collision_key_col("operand")).join(t, "key", "left")
    named = F.when(F.col("operand") == "HEAD", F.lit(head)).when(F.col("operand").rlike(HASH), F.col("operand")).when((F.col("key") != "head") & ~F.col("key").rlike(HASH), F.col("tagged"))
    rows = rows.withColumn("commit_hash", named).join(commits.select("commit_hash").distinct().withColumn("_there", F.lit(True)), "commit_hash", "left")
    reserved = (F.col("operand") != "HEAD") & ~F.col("operand").rlike(HASH) & ((F.col("key") == "head") | F.col("key").rlike(HASH))
    fault = F.coalesce(operand_fault(F.col("operand")), F.when(reserved, "reserved").when(F.col("commit_hash").isNull(), "not_found").when(F.col("_there").isNull(), "shallow"))
    return rows.select("operand", F.when(fault.isNull(), F.col("commit_hash")).alias("commit_hash"), fault.alias("fault"))


def inspect(hashes: DataFrame, commits: DataFrame, entries: DataFrame, objects: DataFrame) -> DataFrame:
    """What each hash is: a commit with its entries, or an object with its bytes; null kinds are unknown."""
    c = entries.groupBy(F.col("commit_hash").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    c = commits.select(F.col("commit_hash").alias("hash")).join(c, "hash", "left").select("hash", F.lit("commit").alias("kind"), F.coalesce("n", F.lit(0)).alias("size"))
    o = objects.select("hash", "kind", F.octet_length("body").cast("bigint").alias("size")).dropDuplicates(["hash", "kind"])
    return hashes.join(c.unionByName(o), "hash", "left")


def status(head_tree: DataFrame, working: DataFrame) -> DataFrame:
    """Paths whose content differs between the head's tree and what is there now."""
    return diff(head_tree, working).where("state <> 'unchanged'")


def retained_instances(entries: DataFrame, reached: DataFrame) -> DataFrame:
    """The distinct normalized instances that commits reached from any root pin, with the number of commits that do."""
    key = ["raw_hash", "tool_profile_hash", "gen"]
    return entries.join(reached.select("commit_hash").distinct(), "commit_hash", "left_semi").groupBy(*key).agg(F.count_distinct("commit_hash").alias("commits"))


def reindex_at(commit: str, entries: DataFrame, units: DataFrame, chunks: DataFrame, max_chars: int = 6000) -> DataFrame:
    """Chunks of the instances that one commit pins which the collection does not have, to be appended."""
    pinned = entries.where(F.col("commit_hash") == commit).select("raw_hash", "tool_profile_hash", "gen").distinct()
    fresh = chunk(units.join(pinned, ["raw_hash", "tool_profile_hash", "gen"], "left_semi"), max_chars)
    return fresh.dropDuplicates(["chunk_id"]).join(chunks.select("chunk_id"), "chunk_id", "left_anti")
