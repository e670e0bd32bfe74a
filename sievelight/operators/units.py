"""Units of documents: mapping between versions, checks of what an adapter returned, promotion and queues."""

from __future__ import annotations

from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lcs_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of the longest common subsequence that moves on in ``a`` wherever this loses nothing.

    The lengths for all ends of ``b`` are one number of len(b) bits per element of ``a``: bit t is
    set where the element t from the end makes the common subsequence longer.
    """
    n, full = len(b), (1 << len(b)) - 1
    where: dict = {}
    for t, y in enumerate(reversed(b)):
        where[y] = where.get(y, 0) | 1 << t
    row, rows = full, [0]
    for x in reversed(a):
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(~row & full)
    length = lambda i, j: (rows[len(a) - i] & ((1 << (n - j)) - 1)).bit_count()  # noqa: E731  of a[i:] and b[j:]
    out, i, j = [], 0, 0
    while i < len(a) and j < n:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[len(a) - i] >> (n - 1 - j) & 1 or length(i + 1, j) == length(i, j):
            i += 1
        else:
            j += 1
    return out


def map_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc, old_unit, new_unit and state of every unit (doc, ord, unit, fingerprint).

    Equal fingerprints in order are unchanged. Between two of them units are paired by
    place: pairs are changed, what is left over is added or removed. The order of a
    document's units has no relational form, so each document is one group.
    """

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("ord"), b.sort_values("ord")
        ua, ub = a["unit"].tolist(), b["unit"].tolist()
        rows, i, j = [], 0, 0
        for x, y in [*lcs_pairs(a["fingerprint"].tolist(), b["fingerprint"].tolist()), (len(ua), len(ub))]:
            for p, q in zip_longest(ua[i:x], ub[j:y]):
                rows.append((p, q, "added" if p is None else "removed" if q is None else "changed"))
            if x < len(ua):
                rows.append((ua[x], ub[y], "unchanged"))
            i, j = x + 1, y + 1
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["doc", "old_unit", "new_unit", "state"])

    kind = dict(new.dtypes)["doc"]
    new = new.select(*[F.col(c).alias(c) for c in ("doc", "ord", "unit", "fingerprint")])  # columns of its own, where both come from one table
    return old.groupBy("doc").cogroup(new.groupBy("doc")).applyInPandas(run, f"doc {kind}, old_unit string, new_unit string, state string")


def change_rates(mapping: DataFrame) -> DataFrame:
    """Per document the numbers of units by state and the change rate (changed + added + removed) / max(new, 1)."""
    n = {s: F.count_if(F.col("state") == s).alias(s) for s in ("unchanged", "changed", "added", "removed")}
    new = F.greatest(F.col("unchanged") + F.col("changed") + F.col("added"), F.lit(1))
    return mapping.groupBy("doc").agg(*n.values()).withColumn("change_rate", (F.col("changed") + F.col("added") + F.col("removed")) / new)


def response_faults(r: DataFrame) -> DataFrame:
    """Responses (arrays updated, added, unchanged, failed, removed, and what was asked: units, asked_changed, asked_added, asked_removed) with the first rule they break, null if none."""
    col = F.col
    parts = [col(c) for c in ("updated", "added", "unchanged", "failed")]
    overlap = F.lit(False)
    for i, x in enumerate(parts):
        for y in parts[i + 1 :]:
            overlap = overlap | F.arrays_overlap(x, y)
    together = F.array_union(F.array_union(parts[0], parts[1]), F.array_union(parts[2], parts[3]))
    same = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)
    fault = (
        F.when(overlap, "not_disjoint")
        .when(~same(together, col("units")), "not_complete")
        .when(~same(col("removed"), col("asked_removed")), "removed_differs")
        .when(F.size(F.array_except("updated", "asked_changed")) > 0, "updated_unasked")
        .when(~same(F.array_union(col("added"), F.array_intersect("failed", "asked_added")), col("asked_added")), "added_differs")
    )
    return r.withColumn("fault", fault)


def duplicate_suffix(df: DataFrame, by: list[str], base: str, order: str) -> DataFrame:
    """Names with #2, #3, ... where they repeat within a group, a # in the name doubled first."""
    from pyspark.sql import Window as W

    escaped = F.replace(base, F.lit("#"), F.lit("##"))
    n = F.row_number().over(W.partitionBy(*by, base).orderBy(order))
    return df.withColumn("key", F.when(n == 1, escaped).otherwise(F.concat(escaped, F.lit("#"), n.cast("string"))))


def promotable(instances: DataFrame, units: DataFrame) -> DataFrame:
    """Online instances all of whose units are done."""
    done = units.groupBy("instance_id").agg(F.bool_and(F.col("state") == "done").alias("_all"))
    return instances.where("online").join(done.where("_all"), "instance_id", "left_semi")


def pollable(requests: DataFrame, now: Column) -> DataFrame:
    """Submitted requests whose next poll is due, oldest first."""
    return requests.where((F.col("state") == 1) & (F.col("next_poll_at") <= now)).orderBy("next_poll_at", "request_id")


def stalled(requests: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Reserved requests that were not submitted within ``seconds``."""
    return requests.where((F.col("state") == 0) & (now - F.col("created_at") > seconds)).orderBy("created_at", "request_id")


def projected_or_fail(markers: DataFrame, scopes: DataFrame) -> DataFrame:
    """Scopes with a marker; one that was never projected is an error, not an empty answer."""
    s = scopes.select("scope_id").distinct().join(markers.select("scope_id", F.lit(True).alias("_m")).distinct(), "scope_id", "left")
    checked = F.when(F.col("_m"), F.col("scope_id")).otherwise(F.raise_error(F.concat(F.lit("not projected: "), F.col("scope_id"))))
    return s.select(checked.alias("scope_id"))
