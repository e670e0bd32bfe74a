"""Registered queries of the index's updates, admission in order and long histories, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluation, history, ledger
from ..operators.index import TextIndex
from ..sources import scan, stores
from ..sources.projections import Projections
from .queries import BM25, PHRASES, corpus, load, query


@query(BM25.replace("FROM documents)", "FROM documents WHERE doc_id % 11 <> 4)", 1) + "SELECT scope_id, chunk_id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY bm25, scope_id, chunk_id)::INT AS rank FROM b ORDER BY rank LIMIT 200")
def bm25_after_updates(spark, sf_dir):
    """Ranks of an index that was built of some documents, appended to, had some replaced and deleted, and was compacted."""
    every = corpus(spark, sf_dir)
    i = F.col("chunk_id").cast("bigint")
    early = every.where(i % 10 != 3).withColumn("text", F.when(i % 13 == 5, F.reverse("text")).otherwise(F.col("text")))
    index = TextIndex.build(early, f"{stores.shared_folder(spark)}/updates-{uuid.uuid4().hex}")
    index = index.append(every.where((i % 10 == 3) | (i % 13 == 5)))  # new ones, and those that had another text
    index = index.delete(every.where(i % 11 == 4)).compact()
    return index.bm25(PHRASES).drop("raw_hash").withColumn("bm25", F.round("bm25", 6))


ADMISSIONS = """
WITH RECURSIVE o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS seq, 's' || o_custkey % 5 AS scope_id, o_orderpriority AS adapter, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE round(o_totalprice * 100)::BIGINT END AS usd, o_orderstatus FROM orders),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY month ORDER BY seq) AS i FROM o WHERE o_orderstatus <> 'P'),
t AS (SELECT * FROM o WHERE o_orderstatus = 'P'),
f AS (SELECT month, map_from_entries(list((scope_id, n))) AS folders FROM (SELECT month, scope_id, sum(usd)::BIGINT AS n FROM t GROUP BY ALL) GROUP BY month),
a AS (SELECT month, map_from_entries(list((adapter, n))) AS adapters FROM (SELECT month, adapter, sum(usd)::BIGINT AS n FROM t GROUP BY ALL) GROUP BY month),
d AS (SELECT month, sum(usd)::BIGINT AS device FROM t GROUP BY month),
s AS (
  SELECT DISTINCT c.month, 0::BIGINT AS i, 0::BIGINT AS seq, coalesce(device, 0) AS device, coalesce(folders, MAP {}) AS folders, coalesce(adapters, MAP {}) AS adapters, NULL::VARCHAR AS denied_by FROM c LEFT JOIN d USING (month) LEFT JOIN f USING (month) LEFT JOIN a USING (month)
  UNION ALL
  SELECT month, i, seq, CASE WHEN stop IS NULL THEN device + usd ELSE device END, CASE WHEN stop IS NULL THEN map_concat(folders, MAP {scope_id: folder + usd}) ELSE folders END, CASE WHEN stop IS NULL THEN map_concat(adapters, MAP {adapter: own + usd}) ELSE adapters END, stop
  FROM (
    SELECT *, CASE WHEN usd = 0 THEN NULL WHEN device + usd >= 2500000000 THEN 'device' WHEN folder + usd >= 600000000 THEN 'folder' WHEN own + usd >= 550000000 THEN 'adapter' END AS stop
    FROM (SELECT s.month, c.i, c.seq, c.usd, c.scope_id, c.adapter, s.device, s.folders, s.adapters, coalesce(s.folders[c.scope_id], 0) AS folder, coalesce(s.adapters[c.adapter], 0) AS own FROM s JOIN c ON c.month = s.month AND c.i = s.i + 1)))
SELECT month, seq, denied_by FROM s WHERE i > 0
"""


@query(ADMISSIONS)
def admissions(spark, sf_dir):
    """Requests let in one after the other under device, folder and adapter caps of the month."""
    cents = F.when(F.col("o_orderkey") % 17 == 0, 0).otherwise(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("bigint")
    o = load(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("scope_id"), F.col("o_orderpriority").alias("adapter"), cents.alias("usd"), "o_orderstatus")
    caps = {"device_cap": 2_500_000_000, "folder_cap": 600_000_000, "adapter_cap": 550_000_000}
    asked = o.where("o_orderstatus <> 'P'").drop("o_orderstatus").withColumns({k: F.lit(v) for k, v in caps.items()})
    return ledger.admit(asked, o.where("o_orderstatus = 'P'").select("month", "scope_id", "adapter", F.col("usd").alias("total"))).select("month", "seq", "denied_by")


@query("""WITH RECURSIVE n AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS total FROM orders),
p AS MATERIALIZED (SELECT i, i - 30 AS up FROM n WHERE i > 30 UNION SELECT i, i - 61 FROM n WHERE i > 61 AND i % 97 = 0),
r AS (SELECT max(total) AS i, 0 AS depth FROM n UNION SELECT p.up, r.depth + 1 FROM r JOIN p ON p.i = r.i)
SELECT k AS commit, min(depth)::INT AS depth FROM r JOIN n USING (i) GROUP BY k""")
def long_ancestry(spark, sf_dir):
    """All ancestors of the last of a long history with merges, and their least depths, by contraction of blocks of numbers."""
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    # commits are numbered by range partitions, so that no task sees all of them
    placed = stores.written(o.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").withColumn("m", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("m", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(sizes.select(F.col("part").alias("p"), F.col("n").alias("of")).alias("b"), F.expr("p < part"), "left").groupBy("part").agg(F.coalesce(F.sum("of"), F.lit(0)).alias("before"))
    n = placed.withColumn("part", F.shiftright("m", 33)).join(before, "part").select("o_orderkey", (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("i"))
    up = n.where("i > 30").select(F.col("i").alias("commit_hash"), (F.col("i") - 30).alias("parent"), F.lit(0).alias("ord"))
    merged = n.where("i > 61 and i % 97 = 0").select(F.col("i").alias("commit_hash"), (F.col("i") - 61).alias("parent"), F.lit(1).alias("ord"))
    reached = history.reachable_by_contraction(n.agg(F.max("i").alias("commit_hash")), up.unionByName(merged), numbered=True)
    return reached.join(n, reached["commit_hash"] == n["i"]).select(F.col("o_orderkey").alias("commit"), "depth")


@query("""WITH f AS (SELECT c_custkey AS k, CASE c_custkey % 9 WHEN 0 THEN 'src/' WHEN 1 THEN '.ssh/' WHEN 2 THEN 'tmp/' WHEN 3 THEN 'a/tmp/' ELSE 'docs/' END || CASE c_custkey % 7 WHEN 0 THEN '.env' WHEN 1 THEN 'id_rsa' WHEN 2 THEN 'token' || c_custkey || '.txt' WHEN 3 THEN 'n' || c_custkey || '.log' WHEN 4 THEN 'keep.log' ELSE c_custkey || '.md' END AS p FROM customer)
SELECT k, p AS relative, NOT (k % 9 IN (2, 3) OR (k % 7 = 3) OR k % 9 = 1 OR k % 7 IN (0, 1)) AS allowed FROM f""")
def scan_policy(spark, sf_dir):
    """Whether the current scan takes up a path: rules in order and known secrets together, folders above it too."""
    k = F.col("c_custkey")
    pick = lambda i, some, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in some.items() for x in kv]), i.cast("int")), F.lit(other))
    name = F.when(k % 7 == 2, F.concat(F.lit("token"), k.cast("string"), F.lit(".txt"))).when(k % 7 == 3, F.concat(F.lit("n"), k.cast("string"), F.lit(".log"))).when(k % 7 > 4, F.concat(k.cast("string"), F.lit(".md"))).otherwise(pick(k % 7, {0: ".env", 1: "id_rsa"}, "keep.log"))
    rows = load(spark, sf_dir, "customer").select(k.alias("k"), F.concat(pick(k % 9, {0: "src/", 1: ".ssh/", 2: "tmp/", 3: "a/tmp/"}, "docs/"), name).alias("relative"))
    return rows.withColumn("allowed", scan.scan_allows(F.col("relative"), ["*.log", "!keep.log", "tmp/"]))


@query("""WITH a AS (SELECT DISTINCT 'h' || vec_id % 400 AS h, CASE WHEN vec_id % 2 = 0 THEN 'x' END AS context, vec_id % 400 AS k FROM embeddings WHERE vec_id < 400),
o AS (SELECT h, context, arg_max(e[1], vec_id) AS first FROM (SELECT 'h' || vec_id % 400 AS h, CASE WHEN vec_id % 2 = 0 THEN 'x' END AS context, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id >= 100) GROUP BY h, context),
c AS (SELECT a.h, a.context, coalesce(o.first, b.embedding[1]::DOUBLE) AS first FROM a LEFT JOIN o ON o.h = a.h AND o.context IS NOT DISTINCT FROM a.context LEFT JOIN embeddings b ON b.vec_id = a.k)
SELECT doc_id, c.first FROM documents d JOIN c ON c.h = 'h' || d.doc_id % 450 AND c.context IS NOT DISTINCT FROM CASE WHEN d.doc_id % 450 % 2 = 0 THEN 'x' END""")
def written_embeddings(spark, sf_dir):
    """Content rows put in or in place, written twice, then linked to chunks."""
    e, i = load(spark, sf_dir, "embeddings"), F.col("vec_id")
    rows = e.select(F.concat(F.lit("h"), (i % 400).cast("string")).alias("target_hash"), F.lit("p").alias("profile_hash"), F.when(i % 2 == 0, "x").alias("context"), F.col("embedding").alias("vector"), i.alias("seq"))
    stored = rows.where("seq < 400").drop("seq")
    once = stores.write_embeddings(stored, rows.where("seq >= 100"), width=64)
    contents = stores.write_embeddings(once, rows.where("seq >= 100"), width=64)
    k = F.col("doc_id") % 450
    chunks = load(spark, sf_dir, "documents").select(F.col("source").alias("scope_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("h"), k.cast("string")).alias("text_hash"), F.lit("p").alias("profile_hash"), F.when(k % 2 == 0, "x").alias("context"), "doc_id")
    return stores.link_embeddings(chunks, contents).where("vector is not null").select("doc_id", F.element_at("vector", 1).cast("double").alias("first"))


@query("""WITH r AS (SELECT 'M' || o_custkey % 4 AS scenario, CASE o_orderkey % 40 WHEN 0 THEN 'failed' WHEN 1 THEN 'unimplemented' ELSE 'ok' END AS status, (o_orderkey % 7 + 3) / 9.0 AS recall, CASE WHEN o_orderkey % 40 <> 0 THEN o_totalprice END AS ms FROM orders),
s AS (SELECT scenario, count(*) AS n_queries, round(avg(CASE WHEN status = 'ok' THEN recall ELSE 0 END), 6) AS recall_at_10, quantile_disc(ms, 0.95) AS p95_ms, avg(CASE WHEN status = 'ok' THEN recall ELSE 0 END) >= 0.632 AS passes_target FROM r GROUP BY scenario)
SELECT *, p95_ms < 420000 + 5000 * substr(scenario, 2)::INT AS passes_latency FROM s""")
def crossscope_scenarios(spark, sf_dir):
    """Recall, percentiles and gates of a run over several scopes."""
    k = F.col("o_orderkey")
    status = F.when(k % 40 == 0, "failed").when(k % 40 == 1, "unimplemented").otherwise("ok")
    rows = load(spark, sf_dir, "orders").select(k.alias("query_id"), F.concat(F.lit("M"), (F.col("o_custkey") % 4).cast("string")).alias("scenario"), status.alias("status"), ((k % 7 + 3) / 9.0).alias("recall"), F.when(k % 40 != 0, F.col("o_totalprice")).alias("duration_ms"), (k % 11).cast("int").alias("worst_rank"))
    targets = rows.select("scenario").distinct().withColumn("target_ms", F.lit(420000) + 5000 * F.substring("scenario", 2, 9).cast("int"))
    scenarios, _ = evaluation.crossscope_report(rows, targets, 0.632)
    return scenarios.select("scenario", "n_queries", F.round("recall_at_10", 6).alias("recall_at_10"), "p95_ms", "passes_target", "passes_latency")


@query("""WITH r AS (SELECT CASE o_orderkey % 40 WHEN 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 11 END AS rank FROM orders)
SELECT count(*) AS n_queries, count(*) FILTER (status <> 'ok') AS n_failed, round(avg(rank), 6) AS worst_rank_mean, max(rank)::INT AS worst_rank_max, false AS all_pass FROM r""")
def crossscope_totals(spark, sf_dir):
    """Failures and worst expected ranks of a run."""
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(k.alias("query_id"), F.lit("M1").alias("scenario"), F.when(k % 40 == 0, "failed").otherwise("ok").alias("status"), F.lit(1.0).alias("recall"), F.lit(1.0).alias("duration_ms"), F.when(k % 3 != 0, (k % 11).cast("int")).alias("worst_rank"))
    _, totals = evaluation.crossscope_report(rows, rows.select("scenario").distinct().withColumn("target_ms", F.lit(5.0)))
    return totals.withColumn("worst_rank_mean", F.round("worst_rank_mean", 6))


@query("""WITH d AS (SELECT coalesce(source, 'none') AS scope_id, doc_id FROM documents), n AS (SELECT * FROM d WHERE scope_id NOT IN ('src1', 'src3') OR doc_id % 2 = 0)
SELECT 'c1' AS answer, scope_id, count(*) AS n, sum(doc_id)::BIGINT AS total FROM d GROUP BY scope_id UNION ALL SELECT 'now', scope_id, count(*), sum(doc_id)::BIGINT FROM n GROUP BY scope_id UNION ALL SELECT 'reader', scope_id, count(*), sum(doc_id)::BIGINT FROM d GROUP BY scope_id""")
def projection_versions(spark, sf_dir):
    """Two scopes show another commit; the old one still answers, and a reader of the version before sees no change."""
    d = load(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("scope_id"), "doc_id")
    first = d.withColumn("commit_hash", F.lit("c1"))
    empty = Projections(spark, f"{stores.shared_folder(spark)}/projections-{uuid.uuid4().hex}", "scope_id string, commit_hash string, doc_id bigint")
    reader = empty.replace(first, {r.scope_id: "c1" for r in d.select("scope_id").distinct().collect()})  # scopes, not rows
    moved = [s for s in reader.scopes if s in ("src1", "src3")]
    later = d.where(F.col("scope_id").isin(moved) & (F.col("doc_id") % 2 == 0)).withColumn("commit_hash", F.lit("c2"))
    now = reader.replace(later, dict.fromkeys(moved, "c2"), preserve_at=True)
    sums = lambda df, name: df.groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("total")).select(F.lit(name).alias("answer"), "scope_id", "n", "total")
    return sums(now.at("c1"), "c1").unionByName(sums(now.current(), "now")).unionByName(sums(reader.current(), "reader"))


@query("""WITH f AS (SELECT c_custkey AS k, 's' || c_custkey % 4 AS scope_id, CASE c_custkey % 3 WHEN 0 THEN 'docs/' WHEN 1 THEN 'tmp/x/' ELSE 'a/tmp/' END || CASE c_custkey % 5 WHEN 0 THEN 'keep.log' WHEN 1 THEN c_custkey || '.log' ELSE c_custkey || '.md' END AS relative FROM customer)
SELECT k, CASE scope_id WHEN 's0' THEN relative LIKE '%.log' AND relative NOT LIKE '%/keep.log' WHEN 's1' THEN relative LIKE '%tmp/%' WHEN 's2' THEN regexp_full_match(relative, 'docs/[^/]*[.]md') AND NOT regexp_full_match(relative, 'docs/[^/]*5[.]md') ELSE false END AS ignored FROM f""")
def rule_sets(spark, sf_dir):
    """Rules of many scopes as a table, the last that matches winning."""
    k = F.col("c_custkey")
    pick = lambda i, some: F.element_at(F.array(*[F.lit(x) for x in some]), (i + 1).cast("int"))
    name = F.when(k % 5 == 0, "keep.log").when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".log"))).otherwise(F.concat(k.cast("string"), F.lit(".md")))
    files = load(spark, sf_dir, "customer").select(k.alias("k"), F.concat(F.lit("s"), (k % 4).cast("string")).alias("scope_id"), F.concat(pick(k % 3, ["docs/", "tmp/x/", "a/tmp/"]), name).alias("relative"))
    rules = spark.createDataFrame([("s0", 1, "*.log"), ("s0", 2, "!keep.log"), ("s1", 1, "# folders"), ("s1", 2, "tmp/"), ("s2", 1, "docs/*.md"), ("s2", 2, "!docs/*5.md")], "scope_id string, ord int, rule string")
    return scan.ignored_by_scope(files, rules).select("k", "ignored")
