"""Costs, budgets and tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Error kind, retryable, attempts (null: no limit), backoff, code, paused.
RETRY = [
    ("network_error", True, 5, "exp(base=2s,cap=60s,jitter=none)", "BATCH-NET-001", False),
    ("rate_limit", True, None, "retry_after", "BATCH-RATE-001", False),
    ("auth_error", False, 0, "user_action", "BATCH-AUTH-001", True),
    ("quota_exceeded", True, 3, "fixed(1h)", "BATCH-QUOTA-001", False),
    ("invalid_input", False, 0, "none", "BATCH-INPUT-001", False),
    ("contract_violation", True, 1, "immediate", "ADAPTER-CONTRACT-001", False),
    ("budget_exceeded", False, 0, "override_budget_required", "BATCH-BUDGET-001", True),
]


def retry_policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RETRY, "error_kind string, retryable boolean, max_attempts int, backoff string, error_code string, paused boolean")


def append_once(ledger: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``rows`` whose key the ledger does not have yet, once each."""
    return rows.dropDuplicates(key).join(ledger.select(*key), key, "left_anti")


def month_totals(ledger: DataFrame, requests: DataFrame, by: list[str]) -> DataFrame:
    """Spent and reserved USD by month and ``by``: ledger rows, and requests in state 0 or 1."""
    spent = ledger.groupBy("month", *by).agg(F.sum("usd").alias("spent"))
    held = requests.where("state in (0, 1)").groupBy("month", *by).agg(F.sum("estimated_usd").alias("reserved"))
    both = spent.join(held, ["month", *by], "full_outer").fillna(0.0, ["spent", "reserved"])
    return both.withColumn("total", F.col("spent") + F.col("reserved"))


def admission(total: Column, candidate: Column, cap: Column) -> Column:
    """False where the candidate would bring the total to the cap; what costs nothing is always let in, and a null cap is none."""
    return (candidate == 0) | cap.isNull() | (total + candidate < cap)


def decide(candidates: DataFrame) -> DataFrame:
    """First cap that denies each candidate: device, folder, then adapter; null if none does."""
    deny = F.lit(None).cast("string")
    for level in ("adapter", "folder", "device"):
        deny = F.when(~admission(F.col(f"{level}_total"), F.col("usd"), F.col(f"{level}_cap")), level).otherwise(deny)
    return candidates.withColumn("denied_by", deny)


def admit(candidates: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates in order under nested caps: what is let in raises the totals that later ones meet, what is denied does not.

    candidates(month, seq, scope_id, adapter, usd, device_cap, folder_cap, adapter_cap, ...) and
    totals(month, scope_id, adapter, total), what was spent or reserved before. Gives each candidate
    denied_by: the first cap (device, folder, then adapter of the month) that total and cost
    would reach, or null. What costs nothing is let in and no cap is one; order is seq, then scope, adapter and cost.
    A null cost is an error. Months are worked on side by side, each as a sorted stream of which
    only the running totals are held.
    """
    before = totals.groupBy("month", "scope_id", "adapter").agg(F.sum("total").alias("usd")).withColumn("_kind", F.lit(0))
    rows = candidates.withColumns({"_kind": F.lit(1), "usd": F.when(F.col("usd").isNull(), F.raise_error(F.lit("a candidate without a cost")).cast(candidates.schema["usd"].dataType)).otherwise(F.col("usd"))})
    rows = before.select("month", "scope_id", "adapter", F.col("usd").cast(candidates.schema["usd"].dataType).alias("usd"), "_kind").unionByName(rows, allowMissingColumns=True)
    rows = rows.select(*candidates.columns, "_kind").repartition("month").sortWithinPartitions("month", "_kind", "seq", "scope_id", "adapter", "usd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, device, folders, adapters = None, 0, {}, {}
        for b in batches:
            denied = []
            for month, kind, scope, adapter, usd, *caps in zip(*(b.column(c).to_pylist() for c in ("month", "_kind", "scope_id", "adapter", "usd", "device_cap", "folder_cap", "adapter_cap")), strict=True):
                if now != (month,):
                    now, device, folders, adapters = (month,), 0, {}, {}
                here = (device, folders.get(scope, 0), adapters.get(adapter, 0))
                stop = next((level for level, total, cap in zip(("device", "folder", "adapter"), here, caps, strict=True) if kind and usd and cap is not None and total + usd >= cap), None)
                denied.append(stop)
                if stop is None:
                    device, folders[scope], adapters[adapter] = here[0] + usd, here[1] + usd, here[2] + usd
            asked = pa.compute.equal(b.column("_kind"), 1)
            columns = [b.column(c) for c in candidates_columns] + [pa.array(denied, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*candidates_columns, "denied_by"]).filter(asked)

    candidates_columns = candidates.columns
    return rows.mapInArrow(run, T.StructType([*candidates.schema.fields, T.StructField("denied_by", T.StringType())]))


def budget_warning(levels: DataFrame, threshold: float = 80.0) -> DataFrame:
    """The level of the worst percentage of its cap, if that is ``threshold`` or more: level, percent."""
    p = levels.where("cap > 0").select("level", (F.col("total") / F.col("cap") * 100).alias("percent"))
    return p.agg(F.max_by(F.struct("level", "percent"), F.struct("percent", "level")).alias("w")).select("w.*").where(F.col("percent") >= threshold)


def task_status(done: Column, failed: Column, precondition_failed: Column) -> Column:
    return F.when(precondition_failed | ((done == 0) & (failed > 0)), "failed").when((done > 0) & (failed > 0), "partial").when(done > 0, "done").otherwise("pending")


def markdownize_mode(c: DataFrame, threshold: float = 0.30, most: int = 5) -> DataFrame:
    """Mode and reason from has_previous, raw_only, incremental (capability), change_rate and consecutive; the first rule that holds decides."""
    reason = (
        F.when(~F.col("has_previous"), "no_previous_done_run")
        .when(~F.col("raw_only"), "identity_changed")
        .when(~F.col("incremental"), "adapter_lacks_incremental_update")
        .when(F.col("change_rate") >= threshold, "change_rate_threshold")
        .when(F.col("consecutive") >= most, "max_consecutive_incremental")
    )
    return c.withColumn("reason", reason).withColumn("mode", F.when(F.col("reason").isNull(), "incremental").otherwise("full"))


def local_cost(size_bytes: Column) -> Column:
    """What local work on so many bytes is taken to cost: one hundredth of a dollar for each million."""
    return size_bytes / F.lit(1e6) * F.lit(0.01)


def change_rate(changed: Column, added: Column, removed: Column, new: Column) -> Column:
    return (changed + added + removed) / F.greatest(new, F.lit(1))


def sweep_quota(items: DataFrame, *, total: int = 256, reserved: int = 128) -> DataFrame:
    """Rows of a bounded sweep: ``reserved`` places for prune rows, the rest for others, unused places go to the other kind.

    items(id, kind 'prune' or other, ord, own): rows of ``own`` keys are taken beside the quota.
    """
    rest = items.where("not own")
    first = lambda kind: rest.where(F.col("kind") == "prune" if kind == "prune" else F.col("kind") != "prune").orderBy("ord", "id").limit(total).withColumn("_k", F.lit(kind))
    rows = first("prune").unionByName(first("other"))  # no more of a kind can be taken than there are places
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("_k").orderBy("ord", "id")))
    sizes = rows.agg(F.count_if(F.col("_k") == "prune").alias("_p"), F.count_if(F.col("_k") == "other").alias("_o"))
    p = F.least("_p", F.greatest(F.lit(reserved), F.lit(total) - F.col("_o")))
    o = F.least("_o", F.lit(total) - p)
    kept = rows.crossJoin(F.broadcast(sizes)).where(F.col("_n") <= F.when(F.col("_k") == "prune", p).otherwise(o))
    return kept.select(*items.columns).unionByName(items.where("own"))
