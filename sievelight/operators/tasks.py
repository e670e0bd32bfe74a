"""Task queues and submission as tables: retries, holds, two-phase requests, sweep receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import RETRY

#: Why a task is held, by its reason.
HOLDS = {"budget_exceeded": "budget", "secrets_tier_b": "tier_b_approval", "auth_error": "auth"}
#: States of a request, and of a sweep.
RESERVED, SUBMITTED, SETTLED, RELEASED = 0, 1, 2, 3
PHASES = ["marked", "receipted", "unlinked", "done"]


def retry_kind(reason: Column) -> Column:
    """The retry contract of a failure; unknown or absent reasons count as broken contracts."""
    known = [k for k, *_ in RETRY]
    return F.when(reason.isin(known), reason).when(reason == "retired_non_live", "invalid_input").otherwise("contract_violation")


def task_rules(tasks: DataFrame) -> DataFrame:
    """What may happen to each task (type, status, reason, attempts): retry_kind, retry_allowed, terminal, hold, can_hold_secret, can_complete, can_resume."""
    kind = retry_kind(F.col("reason"))
    allowed = F.lit(False)
    for name, retryable, most, *_ in RETRY:
        if retryable:
            allowed = allowed | ((F.col("retry_kind") == name) & (F.lit(True) if most is None else F.col("attempts") < most))
    hold = F.lit(None).cast("string")
    for reason, name in HOLDS.items():
        hold = F.when(F.col("reason") == reason, name).otherwise(hold)
    paused = F.col("status") == "paused"
    return (
        tasks.withColumn("retry_kind", kind)
        .withColumn("retry_allowed", allowed)
        .withColumn("terminal", (F.col("status") == "failed") & ~F.col("retry_allowed"))
        .withColumn("hold", F.when(paused, hold))
        .withColumn("can_hold_secret", (F.col("type") == "embedding") & (F.col("status") == "pending"))
        .withColumn("can_complete", F.col("status").isin("pending", "running", "failed") | (paused & F.coalesce(F.col("reason").isin("budget_exceeded", "auth_error"), F.lit(False))))
        .withColumn("can_resume", paused & (F.col("retry_kind") == "auth_error"))
    )


def reserve(requests: DataFrame, wanted: DataFrame) -> DataFrame:
    """First phase: one reservation for each key (idempotency_key, estimated_usd, created_at) that has no request under way.

    A key whose request is reserved, submitted or settled gets none; of several wishes for one key the earliest counts.
    """
    live = requests.where(F.col("state") != RELEASED).select("idempotency_key")
    first = wanted.groupBy("idempotency_key").agg(F.min(F.struct("created_at", "estimated_usd")).alias("w"))
    return first.join(live, "idempotency_key", "left_anti").select("idempotency_key", F.col("w.estimated_usd").alias("estimated_usd"), F.col("w.created_at").alias("created_at"), F.lit(RESERVED).alias("state"))


def settle(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Second phase: the requests' next states, and what each costs in the end.

    outcomes(idempotency_key, [seq,] outcome, usd), taken in the order of seq: 'submitted' moves a
    reservation on, 'done' settles a submitted request at its cost, 'rejected' releases either. An
    outcome that does not fit the state it meets changes nothing. Settled and released requests
    stay. Several outcomes of a key without a seq, or with one seq, are an error. A key has few outcomes,
    which are folded in one row.
    """
    ordered = "seq" in outcomes.columns
    one = F.struct((F.col("seq") if ordered else F.lit(0)).cast("bigint").alias("seq"), "outcome", F.col("usd").cast("double").alias("usd"))
    o = outcomes.groupBy("idempotency_key").agg(F.array_sort(F.collect_list(one)).alias("_outcomes"))
    unclear = F.size(F.array_distinct(F.transform("_outcomes", lambda x: x["seq"]))) < F.size("_outcomes")
    o = o.withColumn("_outcomes", F.when(unclear, F.raise_error(F.concat(F.lit("outcomes without an order of "), F.col("idempotency_key").cast("string"))).cast(o.schema["_outcomes"].dataType)).otherwise(F.col("_outcomes")))

    def step(now: Column, x: Column) -> Column:
        s, what = now["state"], x["outcome"]
        settled, released = (s == SUBMITTED) & (what == "done"), s.isin(RESERVED, SUBMITTED) & (what == "rejected")
        state = F.when((s == RESERVED) & (what == "submitted"), SUBMITTED).when(settled, SETTLED).when(released, RELEASED).otherwise(s)
        return F.struct(state.cast("int").alias("state"), F.when(settled, x["usd"]).when(released, F.lit(0.0)).otherwise(now["cost"]).alias("cost"))

    begin = F.struct(F.col("state").cast("int").alias("state"), F.when(F.col("state") == RELEASED, F.lit(0.0)).alias("cost"))
    rows = requests.join(o, "idempotency_key", "left").withColumn("_end", F.aggregate(F.coalesce("_outcomes", F.array().cast(o.schema["_outcomes"].dataType)), begin, step))
    return rows.withColumns({"next": F.col("_end.state"), "cost_usd": F.col("_end.cost")}).drop("_outcomes", "_end")


def sweep_progress(plan: DataFrame, receipts: DataFrame, trees: DataFrame) -> DataFrame:
    """Per candidate (commit_hash, tree_hash) of a sweep the phase it has reached and what is to be done next.

    A receipt is written before the tree goes, so a commit without a receipt still has its tree;
    one with a receipt whose tree is there is unlinked next, and one without either is broken.
    """
    r = receipts.select("commit_hash").distinct().withColumn("_receipt", F.lit(True))
    t = trees.select("tree_hash").distinct().withColumn("_tree", F.lit(True))
    rows = plan.join(r, "commit_hash", "left").join(t, "tree_hash", "left")
    has, there = F.col("_receipt").isNotNull(), F.col("_tree").isNotNull()
    phase = F.when(has & ~there, "done").when(has, "receipted").when(there, "marked").otherwise("broken")
    step = F.when(F.col("phase") == "marked", "write_receipt").when(F.col("phase") == "receipted", "unlink_tree")
    return rows.withColumn("phase", phase).withColumn("next_step", step).drop("_receipt", "_tree")
