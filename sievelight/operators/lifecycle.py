"""Retention, inventory, purge and verification as queries over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR, DAY, WEEK, MONTH = 3600, 86_400, 604_800, 2_592_000


def retention_tier(age: Column, *, hours: int = 24, hourly_days: int = 7, daily_weeks: int = 4, weekly_months: int = 6) -> Column:
    """-1 for the future, 0 to 3 for recent, hourly, daily and weekly, null beyond."""
    return F.when(age < 0, -1).when(age < hours * HOUR, 0).when(age < hourly_days * DAY, 1).when(age < daily_weeks * WEEK, 2).when(age < weekly_months * MONTH, 3)


def bucket(tier: Column, t: Column) -> Column:
    """The hour, day or Monday-based week of an epoch second, by tier."""
    day = F.floor(t / DAY)
    return F.when(tier == 1, F.floor(t / HOUR)).when(tier == 2, day).when(tier == 3, F.floor((day + 3) / 7)).otherwise(0)


def retained_autos(autos: DataFrame, now: int, **policy: int) -> DataFrame:
    """Automatic commits (commit_hash, t in epoch seconds) that tiers keep, with the reason; the newest of a bucket stays, ties by smallest hash."""
    rows = autos.withColumn("tier", retention_tier(F.lit(now) - F.col("t"), **policy)).where("tier is not null").withColumn("bucket", bucket(F.col("tier"), F.col("t")))
    whole = rows.where("tier <= 0")
    first = W.partitionBy("tier", "bucket").orderBy(F.desc("t"), "commit_hash")
    best = rows.where("tier > 0").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    why = F.element_at(F.array(*map(F.lit, ("future_timestamp", "retained_recent", "retained_hourly", "retained_daily", "retained_weekly"))), F.col("tier") + 2)
    return whole.unionByName(best).select("commit_hash", why.alias("reason"))


def retained_repaired(repaired: DataFrame, keep: int = 5) -> DataFrame:
    """The newest ``keep`` repaired commits (branch, commit_hash, t) of every branch."""
    nth = F.row_number().over(W.partitionBy("branch").orderBy(F.desc("t"), "commit_hash"))
    return repaired.withColumn("nth", nth).where(F.col("nth") <= keep).select("commit_hash").distinct()


def retention_plan(commits: DataFrame, reached: DataFrame, refs: DataFrame, receipts: DataFrame, now: int, *, keep_repaired: int = 5, **policy: int) -> DataFrame:
    """Every commit with its fate: a reason to stay, or ``candidate``.

    commits(commit_hash, commit_type, t, tree_hash); reached(start, commit_hash) from
    all refs(name, commit_hash); receipts(commit_hash) of commits already shallow. A
    candidate whose tree another commit still needs stays.
    """
    branches = refs.where(F.col("name").startswith("heads/")).select(F.col("commit_hash").alias("start")).distinct()
    on_branch = reached.join(branches, "start", "left_semi").select(F.col("start").alias("branch"), "commit_hash").distinct()
    repaired = on_branch.join(commits.where("commit_type = 'repaired'").select("commit_hash", "t"), "commit_hash")
    flag = lambda df, name: df.select("commit_hash").distinct().withColumn(name, F.lit(True))
    c = commits
    for df, name in ((reached, "reachable"), (receipts, "shallow"), (refs, "tip"), (retained_repaired(repaired, keep_repaired), "kept_repair"), (on_branch, "branched")):
        c = c.join(flag(df, name), "commit_hash", "left")
    fate = (
        F.when(F.col("reachable").isNull(), "unreachable_commit")
        .when(F.col("shallow"), "already_shallow")
        .when(F.col("tip"), "ref_tip")
        .when(~F.col("commit_type").isin("auto", "repaired"), "protected_commit_type")
        .when((F.col("commit_type") == "repaired") & F.col("kept_repair"), "retained_repaired")
        .when((F.col("commit_type") == "repaired") & F.col("branched").isNull(), "repaired_without_branch")
    )
    c = c.withColumn("fate", fate)
    autos = retained_autos(c.where("fate is null and commit_type = 'auto'"), now, **policy)
    c = c.join(autos, "commit_hash", "left").withColumn("fate", F.coalesce("fate", "reason", F.lit("candidate")))
    needs = F.max(((F.col("fate") != "candidate") & F.col("shallow").isNull()).cast("int")).over(W.partitionBy("tree_hash"))
    fate = F.when((F.col("fate") == "candidate") & (needs == 1), "shared_tree_non_shallow").otherwise(F.col("fate"))
    return c.withColumn("fate", fate).select("commit_hash", "commit_type", "t", "tree_hash", "fate")


def plan_totals(plan: DataFrame, trees: DataFrame) -> DataFrame:
    """Candidates, their distinct trees and the trees' bytes."""
    out = plan.where("fate = 'candidate'")
    sizes = out.select("tree_hash").distinct().join(trees, "tree_hash", "left")
    return out.agg(F.count(F.lit(1)).alias("candidates")).crossJoin(sizes.agg(F.count(F.lit(1)).alias("trees"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("tree_bytes")))


def reasons(plan: DataFrame) -> DataFrame:
    return plan.where("fate <> 'candidate'").groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


def inventory(objects: DataFrame, protected: DataFrame, recent: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Class and reason of every object (kind, hash): protected by a reference, only listed (kind not swept, or recent), or a candidate."""
    p = protected.select("kind", "hash").distinct().withColumn("_p", F.lit(True))
    r = recent.select("hash").distinct().withColumn("_r", F.lit(True))
    o = objects.join(p, ["kind", "hash"], "left").join(r, "hash", "left")
    reason = F.when(F.col("_p"), "referenced").when(~F.col("kind").isin(*kinds), "kind_not_swept").when(F.col("_r"), "recently_written").otherwise("unreferenced")
    o = o.withColumn("reason", reason)
    return o.withColumn("class", F.when(F.col("reason") == "referenced", "protected").when(F.col("reason") == "unreferenced", "candidate").otherwise("inventory_only")).select(*objects.columns, "class", "reason")


def purge_closure(targets: DataFrame, links: DataFrame) -> DataFrame:
    """Artifacts (kind, hash) to delete with the target raw hashes; what another raw hash uses too is preserved.

    links(raw_hash, kind, hash) says which artifacts each raw hash uses.
    """
    t = targets.select("raw_hash").distinct()
    theirs = links.join(t, "raw_hash", "left_semi").select("kind", "hash").distinct()
    others = links.join(t, "raw_hash", "left_anti").select("kind", "hash").distinct().withColumn("_o", F.lit(True))
    return theirs.join(others, ["kind", "hash"], "left").select("kind", "hash", F.when(F.col("_o"), "preserved").otherwise("deleted").alias("fate"))


def final_events(tombstones: DataFrame, receipts: DataFrame) -> DataFrame:
    """The last event of each raw hash (raw_hash, epoch, event); a receipt wins only with a strictly greater epoch."""
    both = tombstones.withColumn("_w", F.lit(1)).unionByName(receipts.withColumn("_w", F.lit(0)))
    last = both.groupBy("raw_hash").agg(F.max_by(F.struct("epoch", "event"), F.struct("epoch", "_w", "event")).alias("last"))
    return last.select("raw_hash", "last.epoch", "last.event")


def broken_objects(objects: DataFrame, references: DataFrame) -> DataFrame:
    """Findings: objects (hash, body) whose bytes have another hash, and references (commit_hash, hash) to none, with the commits concerned."""
    wrong = objects.where(F.concat(F.lit("sha256:"), F.sha2(F.col("body").cast("binary"), 256)) != F.col("hash")).select("hash", F.lit("hash_mismatch").alias("finding"))
    missing = references.select("hash").distinct().join(objects.select("hash"), "hash", "left_anti").select("hash", F.lit("missing").alias("finding"))
    found = wrong.unionByName(missing)
    return found.join(references, "hash", "left").groupBy("hash", "finding").agg(F.array_sort(F.collect_set("commit_hash")).alias("commits"))
