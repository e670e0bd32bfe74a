"""What a search may look at: configuration generations, pinned instances, runtime bindings, modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a pinned instance is identified by, and what a binding must agree in with the runtime table.
INSTANCE = ["raw_hash", "tool_profile_hash", "gen"]
BINDING = ["scope_id", *INSTANCE, "manifest_hash", "path_at_commit", "pointer_commit", "current_paths", "is_live"]


def current_config(chunks: DataFrame, generations: DataFrame, publications: DataFrame, config_hash: str, most_row: int, most_association: int) -> DataFrame:
    """Chunks (chunk_id, row) up to a high-water mark that a configuration generated and published.

    generations(chunk_id, config_hash, association), publications(chunk_id, config_hash).
    """
    made = generations.where((F.col("config_hash") == config_hash) & (F.col("association") <= most_association)).select("chunk_id")
    told = publications.where(F.col("config_hash") == config_hash).select("chunk_id")
    return chunks.where(F.col("row") <= most_row).join(made, "chunk_id", "left_semi").join(told, "chunk_id", "left_semi")


def pinned_by(chunks: DataFrame, entries: DataFrame) -> list[str]:
    return INSTANCE + (["manifest_hash"] if "manifest_hash" in chunks.columns and "manifest_hash" in entries.columns else [])


def live_chunks(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Chunks of the normalized instances that a tree pins, one row per entry that does; where both sides have manifest_hash it must agree too."""
    return chunks.join(entries, pinned_by(chunks, entries))


def live_counts(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of a tree with the number of chunks that each pins, those without any left out: ``live_chunks`` counted by entry, of which no row is made."""
    key = pinned_by(chunks, entries)
    return entries.join(chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("chunks")), key)


def runtime_bindings(bindings: DataFrame, snapshots: DataFrame, runtime: DataFrame, selector: str) -> DataFrame:
    """Bindings of a selector whose snapshot is the scope's present one and that the runtime table has, column by column; null agrees with null."""
    now = bindings.where(F.col("selector_kind") == selector).join(snapshots.select("scope_id", "snapshot_commit"), ["scope_id", "snapshot_commit"], "left_semi")
    r = runtime.select(*BINDING).distinct()
    on = [now[c].eqNullSafe(r[c]) for c in BINDING]
    return now.join(r, on, "left_semi")


def hits_in_scopes(hits: DataFrame, chunks: DataFrame, scopes: DataFrame) -> DataFrame:
    """Hits of a text index (row, ...) as chunks of the scopes that a query names, rows without a chunk or scope left out."""
    return hits.join(chunks, "row").join(scopes.select("scope_id").distinct(), "scope_id", "left_semi")


def profiles_agree(profiles: DataFrame) -> DataFrame:
    """Per collection whether one profile (dimensions, distance, modality, profile_hash) serves all its scopes; else only text is searched."""
    p = F.struct("dimensions", "distance", "modality", "profile_hash")
    return profiles.groupBy("collection_id").agg((F.min(p) == F.max(p)).alias("agree"))


def modes(requests: DataFrame) -> DataFrame:
    """mode and reason of every request (asked, vectors_ready, agree, consent, in_flight, fail_behavior).

    auto prefers hybrid. The first of these that holds stands in the way of vectors: none
    are there, profiles differ, no consent to go online, the query's vector is under way.
    Then text is searched, unless vectors were asked for by name and the request wants an error.
    """
    reason = (
        F.when(F.col("asked") == "text", F.lit(None).cast("string"))
        .when(~F.col("vectors_ready"), "vectors_unavailable")
        .when(~F.col("agree"), "profile_mismatch")
        .when(~F.col("consent"), "consent_required")
        .when(F.col("in_flight"), "embedding_in_flight")
    )
    named = F.col("asked").isin("vector", "hybrid")
    best = F.when(F.col("asked").isin("auto", "hybrid"), "hybrid").otherwise(F.col("asked"))
    mode = F.when(F.col("reason").isNull(), best).when(named & (F.col("fail_behavior") == "error"), "error").otherwise("text")
    return requests.withColumn("reason", reason).withColumn("mode", mode)


def largest_images(images: DataFrame, ratio: float = 0.25) -> DataFrame:
    """Images (unit, area) of at least ``ratio`` of the unit's largest area; those without an area stay, with an area of nothing go."""
    largest = images.groupBy("unit").agg(F.max("area").alias("_largest"))
    kept = images.join(largest, "unit", "left").where(F.col("area").isNull() | (F.col("area") / F.col("_largest") >= ratio))
    return kept.select(*images.columns)


def first_citing(images: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each image (scope_id, image_id) the first eligible chunk that cites it."""
    return images.join(chunks.select("scope_id", "chunk_id"), ["scope_id", "chunk_id"], "left_semi").groupBy("scope_id", "image_id").agg(F.min("chunk_id").alias("chunk_id"))
