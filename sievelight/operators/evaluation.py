"""Retrieval quality, latency and text accuracy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas import types

HIT = ["raw_hash", "section", "path"]


def recall_at_k(expected: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """query_id, expected, found and recall over distinct (raw_hash, section, path), compared null-safely.

    Expected rows without a raw hash count as expected but cannot be found; a query
    without expected rows has recall 0.
    """
    queries = expected.select("query_id").distinct().unionByName(results.select("query_id").distinct()).distinct()
    e = expected.select("query_id", *HIT).distinct()
    r = results.where(F.col("rank") <= k).select("query_id", *HIT).distinct().withColumn("_hit", F.lit(1))
    on = (e["query_id"] == r["query_id"]) & e["raw_hash"].eqNullSafe(r["raw_hash"]) & e["section"].eqNullSafe(r["section"]) & e["path"].eqNullSafe(r["path"])
    found = e.join(r, on, "left").select(e["query_id"], F.when(e["raw_hash"] != "", F.col("_hit")).alias("_hit"))
    sums = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("found"))
    out = queries.join(sums, "query_id", "left").fillna(0, ["expected", "found"])
    return out.withColumn("recall", F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(0.0))


def nearest_rank(values: Column, p: float) -> Column:
    """The ceil(p n)-th smallest value of a group; null where it is empty."""
    ordered = F.array_sort(F.collect_list(values))
    return F.when(F.size(ordered) > 0, F.element_at(ordered, F.greatest(F.lit(1), F.ceil(F.lit(p) * F.size(ordered)).cast("int"))))


def percentile_disc(df: DataFrame, by: list[str], value: str, p: float, accuracy: int = 10_000) -> DataFrame:
    """The ceil(p n)-th smallest value of each group, by counts of ranges: nothing gathers or sorts a group.

    A first pass gives each group two of its values with the wanted rank between them, a few
    ``accuracy``-ths of its rows apart. A second counts what lies below the first, and each distinct value up to
    the other; only these counts are put in order. Null values don't count; groups without a value have no row.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("_v"))
    near = [max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", near, accuracy).alias("_b"))
    sums = sums.select(*[F.col(k).alias(f"_of{k}") for k in keys], "_n", F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high"))
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(sums[f"_of{k}"])
    near_it = rows.join(sums, same).where("_v <= _high").groupBy(*keys, F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")))
    wanted = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_n")))
    ranked = near_it.withColumn("_upto", upto).withColumn("_wanted", wanted)
    picked = ranked.groupBy(*keys).agg(F.min(F.when(F.col("_v").isNotNull() & (F.col("_upto") >= F.col("_wanted")), F.col("_v"))).alias("percentile"), F.bool_or(F.col("_v").isNull() & (F.col("_upto") >= F.col("_wanted"))).alias("_missed"))
    checked = F.when(F.col("_missed") | F.col("percentile").isNull(), F.raise_error(F.lit("the wanted rank lies outside its bounds")).cast(picked.schema["percentile"].dataType)).otherwise(F.col("percentile"))
    return picked.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], checked.alias("percentile"))


def worst_rank(expected: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """The largest first rank of each query's expected rows; null if any is missing."""
    first = results.groupBy("query_id", *on).agg(F.min("rank").alias("rank"))
    rows = expected.select("query_id", *on).distinct().join(first, ["query_id", *on], "left")
    return rows.groupBy("query_id").agg(F.when(F.count("rank") == F.count(F.lit(1)), F.max("rank")).alias("worst_rank"))


def latency_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    for p, name in ((0.5, "p50"), (0.95, "p95")):
        base = base.join(percentile_disc(df, by, value, p).withColumnRenamed("percentile", name), by, "left")
    return base


def containing(texts: DataFrame, passages: DataFrame, block_chars: int = 1 << 25) -> DataFrame:
    """(doc_id, query_id), distinct: texts (doc_id, text) that contain passages (query_id, passage) as they stand.

    Each text is read once by an automaton of the passages, so nothing is shuffled but the
    finds. Passages are taken in blocks of ``block_chars`` characters, one reading of the texts
    each. Null and empty passages and texts have no finds.
    """
    rows = passages.where(F.length("passage") > 0).select("query_id", "passage")
    size = F.sum(F.length("passage")).over(W.orderBy("query_id").rowsBetween(W.unboundedPreceding, 0))
    blocks = (rows.agg(F.sum(F.length("passage"))).first()[0] or 0) // block_chars + 1
    kind = dict(passages.dtypes)["query_id"]
    id_kind = dict(texts.dtypes)["doc_id"]
    found = None
    for k in range(blocks):
        block = rows if blocks == 1 else rows.withColumn("_block", F.floor(size / block_chars)).where(F.col("_block") == k)
        words: dict[str, list] = {}
        for r in block.collect():  # about ``block_chars`` characters
            words.setdefault(r.passage, []).append(r.query_id)
        sent = texts.sparkSession.sparkContext.broadcast(words)

        def run(batches, sent=sent):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word, ids in sent.value.items():
                automaton.add_word(word, ids)
            automaton.make_automaton() if len(automaton) else None
            for b in batches:
                docs, ids = [], []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    t = text.as_py()
                    held = {i for _, some in automaton.iter(t) for i in some} if t and len(automaton) else ()
                    docs += [doc] * len(held)
                    ids += sorted(held)
                yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field("doc_id").type), pa.array(ids, types.to_arrow_type(q_type))], ["doc_id", "query_id"])

        q_type = passages.schema["query_id"].dataType
        some = texts.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, query_id {kind}")
        found = some if found is None else found.unionByName(some)
    return found.distinct()


def cell_text(value: Column) -> Column:
    """A table cell for comparison: lower case, without white space."""
    return F.regexp_replace(F.lower(value), r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", "")


def golden_run(results: DataFrame, target: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Status of every query, and the scenarios with their means.

    results(query_id, scenario, outcome, recall, latency_ms): 'ok' is scored, 'unsupported' is
    not_implemented, all else failed. Per scenario: n, scored, mean recall over scored and
    failed queries (failed ones count 0), the 95th percentile of the latency of scored ones,
    and passed: something was scored and the mean reaches ``target``.
    """
    status = F.when(F.col("outcome") == "ok", "scored").when(F.col("outcome") == "unsupported", "not_implemented").otherwise("failed")
    rows = results.withColumn("status", status).withColumn("recall", F.when(F.col("status") == "scored", F.col("recall")).when(F.col("status") == "failed", 0.0))
    s = rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "scored").alias("scored"), F.avg("recall").alias("mean_recall"))
    p95 = percentile_disc(rows.where("status = 'scored'"), ["scenario"], "latency_ms", 0.95).withColumnRenamed("percentile", "p95")
    s = s.join(p95, "scenario", "left").withColumn("passed", (F.col("scored") > 0) & (F.col("mean_recall") >= target))
    return rows.select("query_id", "scenario", "status", "recall"), s


def crossscope_report(results: DataFrame, targets: DataFrame, target: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """A run over several scopes: its scenarios, and one row of totals.

    results(query_id, scenario, status, recall, duration_ms, worst_rank), targets(scenario, target_ms).
    A query that is not 'ok' counts with recall 0, and with its duration if it has one. A scenario
    passes if its mean recall reaches ``target`` and the 95th percentile of durations lies below its own; one
    that no query has is left out. The run passes (all_pass) if no query failed and all scenarios pass.
    The mean and the largest worst rank are those of queries that have one.
    """
    rows = results.withColumn("_recall", F.when(F.col("status") == "ok", F.col("recall")).otherwise(0.0))
    s = rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("_recall").alias("recall_at_10"))
    s = s.join(percentile_disc(rows, ["scenario"], "duration_ms", 0.95).withColumnRenamed("percentile", "p95_ms"), "scenario", "left").join(targets, "scenario", "left")
    s = s.withColumns({"passes_target": F.coalesce(F.col("recall_at_10") >= target, F.lit(False)), "passes_latency": F.coalesce(F.col("p95_ms") < F.col("target_ms"), F.lit(False))})
    totals = rows.agg(F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col("status") != "ok").alias("n_failed"), F.avg("worst_rank").alias("worst_rank_mean"), F.max("worst_rank").alias("worst_rank_max"))
    passed = s.agg(F.coalesce(F.bool_and(F.col("passes_target") & F.col("passes_latency")), F.lit(True)).alias("_passed"))
    return s, totals.crossJoin(passed).withColumn("all_pass", (F.col("n_failed") == 0) & F.col("_passed")).drop("_passed")  # one row with one row


#: What a report of time and cost measures.
MEASURES = ["baseline_ttfv_ms", "enriched_ttfv_ms", "preview_cost_micro_usd", "actual_cost_micro_usd"]


def assessments(measurements: DataFrame) -> DataFrame:
    """Per report (report_id; measure, state measured / not-measured / blocked, value, reason) its assessment and cost ratio.

    One blocked measure blocks the report; it is measured if all four are. A measured value
    without a number, and another state without a reason, is an error.
    """
    broken = F.when((F.col("state") == "measured") & F.col("value").isNull(), F.raise_error(F.lit("a measured value is missing"))).when((F.col("state") != "measured") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), F.raise_error(F.lit("a reason is missing")))
    rows = measurements.withColumn("state", F.coalesce(broken.cast("string"), F.col("state")))
    one = {m: F.max(F.when((F.col("measure") == m) & (F.col("state") == "measured"), F.col("value"))).alias(m) for m in MEASURES}
    g = rows.groupBy("report_id").agg(F.bool_or(F.col("state") == "blocked").alias("_blocked"), F.count_distinct(F.when((F.col("state") == "measured") & F.col("measure").isin(MEASURES), F.col("measure"))).alias("_measured"), *one.values())
    g = g.withColumn("assessment", F.when(F.col("_blocked"), "blocked").when(F.col("_measured") == len(MEASURES), "measured").otherwise("not-measured"))
    ratio = F.when(F.col("preview_cost_micro_usd") > 0, F.col("actual_cost_micro_usd") / F.col("preview_cost_micro_usd"))
    return g.withColumn("cost_ratio", F.when(F.col("assessment") == "measured", ratio)).drop("_blocked", "_measured")


def coverage(operations: DataFrame, kinds: tuple[str, ...] = ("edited_old", "rename", "deleted")) -> DataFrame:
    """Per query group (group, kind, found) how many operations of history it has and whether all of its kinds are found; a group with a kind outside ``kinds`` is an error."""
    known = F.when(~F.col("kind").isin(*kinds), F.raise_error(F.concat(F.lit("unknown kind: "), "kind")).cast("boolean")).otherwise(F.col("found"))
    by = operations.withColumn("found", known).groupBy("group", "kind").agg(F.bool_or("found").alias("found"), F.count(F.lit(1)).alias("n"))
    return by.groupBy("group").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.bool_and("found").alias("covered"))


def character_error_rate(truth: Column, text: Column) -> Column:
    """Edits per character of ``truth`` against the best window of its length in ``text``; 0 for empty truth."""
    n = F.length(truth)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.levenshtein(truth, F.substring(text, i, n)))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.array_min(windows) / n))


def cell_recall(cells: Column, text: Column) -> Column:
    """Share of the cells that occur in the text; 1 without cells."""
    found = F.size(F.filter(cells, lambda c: F.contains(text, c)))
    return F.when(F.size(cells) == 0, 1.0).otherwise(found / F.size(cells))


def formula_class(tokens: Column, text: Column, has_image: Column) -> Column:
    return F.when(F.exists(tokens, lambda t: F.contains(text, t)), "textized").when(has_image, "image_fallback").otherwise("missing")


def neighbour_agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per query the share of common neighbours among the first ``k`` of two rankings (query_id, id, rank), and whether the first agree."""
    near = lambda df, name: df.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("id").alias(name), F.max(F.when(F.col("rank") == 1, F.col("id"))).alias(f"{name}1"))
    both = near(a, "x").join(near(b, "y"), "query_id")
    return both.select("query_id", (F.size(F.array_intersect("x", "y")) / F.lit(k)).alias("overlap"), (F.col("x1") == F.col("y1")).alias("same_first"))


def nearest(vectors: DataFrame, asked: Column, k: int, block: int = 4096) -> DataFrame:
    """(query_id, id, rank): the ``k`` rows of highest cosine (ties to smaller ids) for the rows that the condition ``asked`` on id picks, the row itself left out.

    ``vectors`` has id and vector, all of one width. Queries and rows meet in blocks, each of
    which a matrix product solves; rows without a norm take no part.
    """
    own = vectors.where(asked)
    rows, queries = vectors.count(), own.count()
    dealt = lambda df, n: F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // block)))).cast("int")
    d = vectors.select(dealt(vectors, rows).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-queries // block)) - 1))).alias("group"), "id", "vector")
    q = own.withColumn("group", dealt(own, queries)).select("group", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-rows // block)) - 1))).alias("part"), "id", "vector")

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        (qi, qv), (di, dv) = (unit_rows(t) for t in (a, b))
        c = qv @ dv.T if len(qi) and len(di) else np.zeros((len(qi), len(di)))
        c[qi[:, None] == di[None]] = -np.inf
        best = [np.lexsort((di, -row))[:k] for row in c]
        keep = [(i, j) for i, js in enumerate(best) for j in js if c[i, j] > -np.inf]
        return pa.table({"query_id": pa.array([int(qi[i]) for i, _ in keep], pa.int64()), "id": pa.array([int(di[j]) for _, j in keep], pa.int64()), "c": pa.array([float(c[i, j]) for i, j in keep], pa.float64())})

    found = q.groupBy("group", "part").cogroup(d.groupBy("group", "part")).applyInArrow(solve, "query_id bigint, id bigint, c double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("c"), "id"))).where(F.col("rank") <= k).drop("c")


def unit_rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of unit length of the rows that have one."""
    ids, lists = t.column("id").to_numpy(), t.column("vector").to_pylist()
    kept = [i for i, v in enumerate(lists) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    if not kept:
        return np.empty(0, np.int64), np.empty((0, 0))
    v = np.array([lists[i] for i in kept], dtype=np.float64)
    return ids[kept], v / np.linalg.norm(v, axis=1, keepdims=True)


def gates(hits: DataFrame, *, least: float = 0.8, margin: float = 0.3) -> DataFrame:
    """Per class the share of hits (class, ours, other), and whether it is ``least`` or more and ``margin`` ahead."""
    g = hits.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ours").cast("double")).alias("ours"), F.avg(F.col("other").cast("double")).alias("other"))
    return g.withColumn("passes", (F.col("ours") >= least) & (F.col("ours") - F.col("other") >= margin))


def same_space(pairs: DataFrame, threshold: float = 0.999, by: list[str] | None = None) -> DataFrame:
    """Least and mean cosine of pairs of vectors (of each group), and whether two embedders share a space."""
    s = pairs.groupBy(*(by or [])).agg(F.count("cosine").alias("n"), F.min("cosine").alias("least"), F.avg("cosine").alias("mean"))
    return s.withColumn("verdict", F.when(F.col("n") == 0, "no_pairs").when(F.col("least") >= threshold, "same_space").otherwise("different_space"))


def rerank_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per query the rank before and after, and whether it improved, worsened or stayed."""
    b, a = before.select("query_id", F.col("rank").alias("before")), after.select("query_id", F.col("rank").alias("after"))
    both = b.join(a, "query_id", "full_outer")
    far = lambda c: F.coalesce(F.col(c), F.lit(2**31 - 1))
    return both.withColumn("effect", F.when(far("after") < far("before"), "improved").when(far("after") > far("before"), "worsened").otherwise("same"))
