"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), as a written table; root is the component's smallest node.

    Alternates the large-star and small-star steps: each rewires neighbours to the
    smallest node they know, so that a component becomes a star in a logarithmic
    number of rounds. Minima are pre-aggregated before the shuffle, and rewiring is
    an equi-join that the adaptive planner can split at a hot node. Loops are ignored.
    The tables of earlier rounds are deleted as soon as the next is written.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = materialize(both.where("b > a").join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        then = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        release(now, large)
        now = then
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out = materialize(nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
            release(now)
            return out
        seen = tuple(state)
    raise RuntimeError("components did not settle")
