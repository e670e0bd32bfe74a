"""Retrieval: text and vector lanes, fusion, diversification, grouping and paging.

A corpus is a DataFrame of chunks (scope_id, chunk_id, raw_hash, heading_path as JSON
text, text). Statistics are those of the whole corpus; rows are restricted afterwards,
but before the depth cut. Every ranking has a total order.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import occurrences
from ..functions.vectors import rank_cosine, similarity

K1, B = 1.2, 0.75
#: Weights of the text and of the heading column.
TEXT_WEIGHT, HEADING_WEIGHT = 1.0, 0.3
KEY = ["scope_id", "chunk_id"]


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows with their rank; ranks are given to the rows of the cut only."""
    cut = df.orderBy(*order).limit(n)
    return cut.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def settled(lane: DataFrame, depth: int = 200) -> DataFrame:
    """A lane's rows, ``depth`` at most, computed once: whatever is built on them does not run the lane again."""
    rows = lane.limit(depth + 1).toArrow()
    if rows.num_rows > depth:
        raise ValueError(f"a lane has more than {depth} rows")
    return lane.sparkSession.createDataFrame(rows, lane.schema).coalesce(1)  # so few rows need no exchange


def together(spark: SparkSession, *lanes: Callable[[], DataFrame], depth: int = 200) -> list[DataFrame]:
    """``settled`` lanes, planned and run at the same time; each is given as a function that makes it."""
    one = inheritable_thread_target(spark)(lambda make: settled(make(), depth))
    with ThreadPoolExecutor(max_workers=len(lanes)) as pool:
        return list(pool.map(one, lanes))


def eligible_rows(df: DataFrame, eligible: DataFrame | None, key: list[str] = KEY) -> DataFrame:
    return df if eligible is None else df.join(eligible.select(*key).distinct(), key, "left_semi")


def phrase_counts(corpus: DataFrame, phrases: list[str]) -> DataFrame:
    """Per chunk its trigram length and, for each phrase, its weighted occurrences f0, f1, ..."""
    size = F.greatest(F.lit(0), F.length("text") - 2) + F.greatest(F.lit(0), F.length("heading_path") - 2)
    lowered = corpus.select(*KEY, size.cast("double").alias("size"), F.lower("text").alias("text"), F.lower("heading_path").alias("heading"))
    f = [(TEXT_WEIGHT * occurrences(F.col("text"), p) + HEADING_WEIGHT * occurrences(F.col("heading"), p)).alias(f"f{i}") for i, p in enumerate(phrases)]
    return lowered.select(*KEY, "size", *f)


def corpus_statistics(counts: DataFrame, n: int) -> DataFrame:
    """One row: chunks, mean length, and for each of ``n`` phrases the chunks that hold it."""
    return counts.agg(F.count(F.lit(1)).alias("chunks"), (F.sum("size") / F.count(F.lit(1))).alias("mean"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(n)])


def bm25(corpus: DataFrame, phrases: list[str], eligible: DataFrame | None = None, depth: int = 200) -> DataFrame:
    """The ``depth`` best chunks for phrases OR-ed together: scope_id, chunk_id, bm25 (lower is better), rank."""
    counts = phrase_counts(corpus, phrases)
    stats = corpus_statistics(counts, len(phrases))
    hits = eligible_rows(counts.where(" or ".join(f"f{i} > 0" for i in range(len(phrases)))), eligible)
    score = F.lit(0.0)
    for i in range(len(phrases)):
        n = F.col(f"n{i}")
        idf = F.log((F.col("chunks") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        f = F.col(f"f{i}")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = hits.crossJoin(F.broadcast(stats)).select(*KEY, score.alias("bm25"))  # one row of statistics
    return top(scored, depth, "bm25", *KEY)


def short_lane(corpus: DataFrame, tokens: list[list[str]], eligible: DataFrame | None = None, depth: int = 200) -> DataFrame:
    """Chunks that hold a form of every token, by the first place of the first token's first form; score 0."""
    hit = F.lit(True)
    for forms in tokens:
        one = F.lit(False)
        for form in forms:
            one = one | (F.instr("text", form) > 0)
        hit = hit & one
    rows = eligible_rows(corpus.where(hit).select(*KEY, F.instr("text", tokens[0][0]).alias("position")), eligible)
    return top(rows, depth, "position", *KEY).withColumn("bm25", F.lit(0.0))


def vector_lane(vectors: DataFrame, query: list[float], eligible: DataFrame | None = None, depth: int = 200) -> DataFrame:
    """The ``depth`` rows of highest cosine among chunks and images together.

    ``vectors`` has scope_id, chunk_id, image_id (null for chunks) and vector. Images
    come in through their first citing chunk that is eligible, before widths are
    compared. Rows of another width, of norm zero or without a finite cosine drop out.
    """
    rows = eligible_rows(vectors, eligible)
    first = W.partitionBy("scope_id", "image_id").orderBy("chunk_id")
    images = rows.where("image_id is not null").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    both = rows.where("image_id is null").unionByName(images)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = both.select(*KEY, "image_id", rank_cosine(F.col("vector"), q).alias("cosine")).where("cosine is not null")
    return top(scored, depth, F.desc("cosine"), "scope_id", F.coalesce("image_id", "chunk_id"), "chunk_id")


def fuse(text: DataFrame, vector: DataFrame, *, k: int = 60, text_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two lanes (scope_id, chunk_id, [image_id,] rank); a missing lane adds nothing.

    Image rows take the text rank of the chunk that cites them, which has a row of its own
    if it is in either lane itself. Each lane is read once: what it says of a chunk meets in
    one group.
    """
    found = F.struct("image_id" if "image_id" in vector.columns else F.lit(None).cast("string").alias("image_id"), F.col("rank").alias("vector_rank"))
    t = text.select(*KEY, F.col("rank").alias("text_rank"), F.lit(None).cast("struct<image_id:string,vector_rank:int>").alias("found"))
    v = vector.select(*KEY, F.lit(None).cast("int").alias("text_rank"), found.cast("struct<image_id:string,vector_rank:int>").alias("found"))
    g = t.unionByName(v).groupBy(*KEY).agg(F.max("text_rank").alias("text_rank"), F.collect_list("found").alias("found"))
    alone = F.array(F.lit(None).cast("struct<image_id:string,vector_rank:int>"))
    text_only = F.col("text_rank").isNotNull() & ~F.exists("found", lambda x: x["image_id"].isNull())
    g = g.select(*KEY, "text_rank", F.explode(F.when(text_only, F.concat("found", alone)).otherwise(F.col("found"))).alias("found"))
    rows = g.select(*KEY, F.col("text_rank"), F.col("found.vector_rank").alias("vector_rank"), F.col("found.image_id").alias("image_id"))
    part = lambda rank, w: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    rows = rows.withColumn("score", part("text_rank", text_weight) + part("vector_rank", vector_weight))
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id", "scope_id", "image_id")))


def cap_per_document(ranked: DataFrame, most: int = 3) -> DataFrame:
    """At most ``most`` rows of each raw_hash in rank order (0: all), ranked anew."""
    if most:
        nth = F.row_number().over(W.partitionBy("raw_hash").orderBy("rank"))
        ranked = ranked.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    return ranked.withColumn("rank", F.row_number().over(W.orderBy("rank")))


def mmr_order(relevance: np.ndarray, vectors: list[np.ndarray], lam: float) -> list[int]:
    """Greedy order by lam * relevance - (1 - lam) * max(0, largest similarity to what is chosen); ties go to the earlier row."""
    low, high = relevance.min(), relevance.max()
    scaled = np.ones(len(relevance)) if high - low < np.finfo(float).eps else (relevance - low) / (high - low)
    left, chosen, worst = list(range(len(relevance))), [], np.zeros(len(relevance))
    while left:
        best, value = left[0], -np.inf
        for i in left:
            v = lam * scaled[i] - (1 - lam) * worst[i]
            if v > value + 1e-12:
                best, value = i, v
        left.remove(best)
        chosen.append(best)
        for i in left:
            worst[i] = max(worst[i], similarity(vectors[i], vectors[best]))
    return chosen


def diversify(ranked: DataFrame, *, lam: float = 0.7, depth: int = 100, most: int = 3, strategy: str = "mmr", by: list[str] | None = None) -> DataFrame:
    """Diversified order of each query's candidates (rank, score, raw_hash, vector).

    ``mmr`` reorders the first ``depth``, unless any candidate has no vector, and caps
    each document; ``group_by_raw_hash`` caps only; ``off`` changes nothing. The greedy
    order needs one query's candidates together; lanes bound them.
    """
    if strategy == "off":
        return ranked
    if strategy == "group_by_raw_hash":
        return cap_per_document(ranked, most)
    keys = by or []
    schema = ranked.schema

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank", kind="stable").reset_index(drop=True)
        if len(g) and g["vector"].notna().all():
            n = min(depth, len(g))
            order = mmr_order(g["score"].to_numpy(float)[:n], [np.asarray(v, dtype=float) for v in g["vector"][:n]], lam)
            g = g.iloc[order + list(range(n, len(g)))].reset_index(drop=True)
        if most:
            g = g[g.groupby("raw_hash", dropna=False).cumcount() < most]
        return g.assign(rank=np.arange(1, len(g) + 1, dtype=np.int32))

    return ranked.groupBy(*keys).applyInPandas(run, schema)


def group_documents(ranked: DataFrame) -> DataFrame:
    """The first row of every (scope_id, raw_hash), ranked anew."""
    nth = F.row_number().over(W.partitionBy("scope_id", "raw_hash").orderBy("rank"))
    first = ranked.withColumn("nth", nth).where("nth = 1").drop("nth")
    return first.withColumn("rank", F.row_number().over(W.orderBy("rank")))


def expand_aliases(ranked: DataFrame, bindings: DataFrame) -> DataFrame:
    """One row per binding (path, commit_hash) of each result, in the order rank, scope, chunk, path, commit; scores are copied. Results without a binding drop out."""
    rows = ranked.join(bindings, KEY)
    order = W.orderBy("rank", "scope_id", "chunk_id", "path", "commit_hash")
    return rows.withColumn("row", F.row_number().over(order))


def page(ranked: DataFrame, offset: int = 0, limit: int = 10) -> DataFrame:
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def without_purged(ranked: DataFrame, active_purges: DataFrame) -> DataFrame:
    """Candidates of scopes without a purge in progress."""
    return ranked.join(active_purges.select("scope_id").distinct(), "scope_id", "left_anti")


def rerank(ranked: DataFrame, order: DataFrame, by: list[str]) -> DataFrame:
    """Candidates in the order of ``order`` (keys, new_rank); those it does not name follow as they were."""
    rows = ranked.join(order, by, "left")
    w = W.orderBy(F.col("new_rank").isNull(), "new_rank", "rank")
    return rows.withColumn("rank", F.row_number().over(w)).drop("new_rank")


def resolve_mode(asked: str, *, vectors_ready: bool, online_allowed: bool, agree: bool = True, fail_behavior: str = "fallback") -> tuple[str, str | None]:
    """(mode, reason for falling back) of one request, by the rules of ``eligibility.modes``; an error where the request wants one."""
    if asked == "text":
        return "text", None
    reason = "vectors_unavailable" if not vectors_ready else "profile_mismatch" if not agree else "consent_required" if not online_allowed else None
    if reason is None:
        return ("hybrid" if asked in ("auto", "hybrid") else "vector"), None
    if asked != "auto" and fail_behavior == "error":
        raise ValueError(reason)
    return "text", reason
