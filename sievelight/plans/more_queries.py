"""Registered queries of eligibility, names of commits, tasks, registries and reports, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import hashing, text, vectors
from ..operators import chunking, eligibility, evaluation, evidence, history, ledger, refs, tasks, units
from ..sources import stores
from .queries import HISTORY, commit_tables, load, query, text_index

PAD = "lpad(doc_id::VARCHAR, 10, '0')"


def pad(c):
    return F.lpad(F.col(c).cast("string"), 10, "0")


# --- eligibility --------------------------------------------------------------------


@query("""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'c1' ELSE 'c2' END AS config, doc_id * 2 AS association FROM documents UNION ALL SELECT doc_id, 'c2', doc_id * 2 + 1 FROM documents WHERE doc_id % 6 = 0),
p AS (SELECT doc_id, 'c2' AS config FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'c1' FROM documents)
SELECT doc_id FROM documents d WHERE doc_id <= (SELECT max(doc_id) * 3 // 4 FROM documents) AND EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id AND config = 'c2' AND association <= (SELECT max(doc_id) FROM documents)) AND EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id AND config = 'c2')""")
def configured_chunks(spark, sf_dir):
    """Chunks that the present configuration made and published, up to both high-water marks."""
    d = load(spark, sf_dir, "documents").select("doc_id")
    top = d.agg(F.max("doc_id")).first()[0] or 0
    i = F.col("doc_id")
    made = d.select(i.alias("chunk_id"), F.when(i % 3 == 0, "c1").otherwise("c2").alias("config_hash"), (i * 2).alias("association"))
    made = made.unionByName(d.where("doc_id % 6 = 0").select(i.alias("chunk_id"), F.lit("c2").alias("config_hash"), (i * 2 + 1).alias("association")))
    told = d.where("doc_id % 5 <> 0").select(i.alias("chunk_id"), F.lit("c2").alias("config_hash")).unionByName(d.select(i.alias("chunk_id"), F.lit("c1").alias("config_hash")))
    chunks = d.select(i.alias("chunk_id"), i.alias("row"))
    return eligibility.current_config(chunks, made, told, "c2", top * 3 // 4, top).select(F.col("chunk_id").alias("doc_id"))


@query("""WITH c AS (SELECT l_orderkey AS k, l_partkey % 1000 AS raw_hash, l_linenumber % 2 AS gen, l_suppkey % 3 AS manifest FROM lineitem),
e AS (SELECT o_orderkey AS path, o_custkey % 1000 AS raw_hash, o_orderkey % 2 AS gen, o_custkey % 3 AS manifest FROM orders)
SELECT e.path, count(*) AS chunks FROM c JOIN e ON c.raw_hash = e.raw_hash AND c.gen = e.gen AND c.manifest = e.manifest GROUP BY e.path""")
def pinned_chunks(spark, sf_dir):
    """Chunks of the instances that a tree pins, by hash, tool, generation and manifest."""
    c = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1000).alias("raw_hash"), F.lit("t").alias("tool_profile_hash"), (F.col("l_linenumber") % 2).cast("bigint").alias("gen"), (F.col("l_suppkey") % 3).alias("manifest_hash"))
    e = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 1000).alias("raw_hash"), F.lit("t").alias("tool_profile_hash"), (F.col("o_orderkey") % 2).cast("bigint").alias("gen"), (F.col("o_custkey") % 3).alias("manifest_hash"))
    return eligibility.live_counts(c, e).groupBy("path").agg(F.sum("chunks").alias("chunks"))


@query("""WITH b AS (SELECT o_orderkey AS chunk_id, o_custkey % 20 AS scope_id, CASE WHEN o_orderkey % 2 = 0 THEN 'current' ELSE 'at' END AS selector, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS snapshot, o_custkey % 7 AS raw_hash, o_orderkey % 2 AS gen, CASE WHEN o_custkey % 5 <> 0 THEN 'm' END AS manifest FROM orders),
r AS (SELECT DISTINCT o_custkey % 20 AS scope_id, o_custkey % 7 AS raw_hash, o_orderkey % 2 AS gen, CASE WHEN o_custkey % 5 <> 0 THEN 'm' END AS manifest FROM orders WHERE o_custkey % 4 = 1)
SELECT chunk_id FROM b WHERE selector = 'current' AND snapshot = 'new' AND scope_id <> 3 AND EXISTS (SELECT 1 FROM r WHERE r.scope_id = b.scope_id AND r.raw_hash = b.raw_hash AND r.gen = b.gen AND r.manifest IS NOT DISTINCT FROM b.manifest)""")
def eligible_bindings(spark, sf_dir):
    """Bindings of the present snapshot that the runtime table has, in nine columns."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    shared = [(F.col("o_custkey") % 20).alias("scope_id"), (F.col("o_custkey") % 7).alias("raw_hash"), F.lit("t").alias("tool_profile_hash"), (k % 2).alias("gen"), F.when(F.col("o_custkey") % 5 != 0, "m").alias("manifest_hash"), F.lit("p").alias("path_at_commit"), F.lit("c").alias("pointer_commit"), F.array(F.lit("p")).alias("current_paths"), F.lit(True).alias("is_live")]
    b = o.select(k.alias("chunk_id"), F.when(k % 2 == 0, "current").otherwise("at").alias("selector_kind"), F.when(k % 3 == 0, "old").otherwise("new").alias("snapshot_commit"), *shared)
    s = b.select("scope_id").distinct().where("scope_id <> 3").withColumn("snapshot_commit", F.lit("new"))
    return eligibility.runtime_bindings(b, s, o.where("o_custkey % 4 = 1").select(*shared), "current").select("chunk_id")


@query("""WITH h AS (SELECT source AS scope_id, """ + PAD + """ AS chunk_id, (length(text) - length(replace(lower(text), 'licensed under', ''))) / 14 AS n FROM documents WHERE contains(lower(text), 'licensed under') AND source IN ('src2', 'src4', 'src6'))
SELECT scope_id, chunk_id, n::DOUBLE AS occurrences FROM h""")
def hits_in_scopes(spark, sf_dir):
    """Hits of the text index as chunks of the scopes that a query names."""
    found = text_index(spark, sf_dir)
    hits = found.counts(["licensed under"]).select(F.col("doc").alias("row"), F.col("f0").alias("occurrences"))
    scopes = spark.createDataFrame([("src2",), ("src4",), ("src6",), ("src6",)], "scope_id string")
    return eligibility.hits_in_scopes(hits, found.docs.withColumnRenamed("doc", "row"), scopes).select("scope_id", "chunk_id", "occurrences")


@query("""WITH p AS (SELECT label AS scope_id, label % 4 AS collection_id, CASE WHEN label = 6 THEN 32 ELSE len(embedding) END AS dimensions FROM embeddings), a AS (SELECT collection_id, count(DISTINCT dimensions) = 1 AS agree FROM p GROUP BY 1),
r AS (SELECT o_orderkey, ['auto', 'text', 'vector', 'hybrid'][o_orderkey % 4 + 1] AS asked, o_custkey % 7 <> 0 AS ready, o_custkey % 4 AS collection_id, o_custkey % 5 <> 0 AS consent, o_custkey % 11 = 0 AS flight, CASE WHEN o_custkey % 2 = 0 THEN 'error' ELSE 'fallback' END AS fail FROM orders),
x AS (SELECT o_orderkey, asked, fail, CASE WHEN asked = 'text' THEN NULL WHEN NOT ready THEN 'vectors_unavailable' WHEN NOT agree THEN 'profile_mismatch' WHEN NOT consent THEN 'consent_required' WHEN flight THEN 'embedding_in_flight' END AS reason FROM r JOIN a USING (collection_id))
SELECT o_orderkey, reason, CASE WHEN reason IS NULL THEN CASE WHEN asked IN ('auto', 'hybrid') THEN 'hybrid' ELSE asked END WHEN asked IN ('vector', 'hybrid') AND fail = 'error' THEN 'error' ELSE 'text' END AS mode FROM x""")
def search_modes(spark, sf_dir):
    """What each request searches, given vectors, profiles, consent and what is under way."""
    e = load(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("collection_id"), F.when(F.col("label") == 6, 32).otherwise(F.size("embedding")).alias("dimensions"), F.lit("cosine").alias("distance"), F.lit("text").alias("modality"), F.lit("p").alias("profile_hash"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = F.element_at(F.array(*map(F.lit, ["auto", "text", "vector", "hybrid"])), (k % 4 + 1).cast("int"))
    r = load(spark, sf_dir, "orders").select(k, asked.alias("asked"), (c % 7 != 0).alias("vectors_ready"), (c % 4).cast("int").alias("collection_id"), (c % 5 != 0).alias("consent"), (c % 11 == 0).alias("in_flight"), F.when(c % 2 == 0, "error").otherwise("fallback").alias("fail_behavior"))
    return eligibility.modes(r.join(eligibility.profiles_agree(e), "collection_id")).select("o_orderkey", "reason", "mode")


@query("""WITH i AS (SELECT label AS scope_id, 'img' || (vec_id % 7) AS image_id, """ + PAD.replace("doc_id", "vec_id") + """ AS chunk_id, vec_id FROM embeddings), c AS (SELECT * FROM i WHERE vec_id % 4 <> 1)
SELECT scope_id, image_id, min(chunk_id) AS chunk_id FROM c GROUP BY ALL""")
def citing_chunks(spark, sf_dir):
    """The first eligible chunk that cites each image."""
    i = load(spark, sf_dir, "embeddings").select(F.col("label").alias("scope_id"), F.concat(F.lit("img"), (F.col("vec_id") % 7).cast("string")).alias("image_id"), pad("vec_id").alias("chunk_id"), "vec_id")
    return eligibility.first_citing(i.drop("vec_id"), i.where("vec_id % 4 <> 1"))


# --- identities ---------------------------------------------------------------------


@query("""SELECT vec_id, 'sha256:' || sha256('{' || CASE WHEN label % 2 = 0 THEN '"context":"c' || label || '",' ELSE '' END || '"dimensions":' || len(embedding) || ',"distance":"cosine","modality":"text","profile_hash":"p","spec_version":1,"target_hash":"h' || vec_id || '","target_type":"chunk"}') AS embedding_id,
'sha256:' || sha256('{"max_chars":' || (1000 + label) || ',"spec_version":1,"strategy":"heading"}') AS config_hash, 'sha256:' || sha256('{' || CASE WHEN label % 3 = 0 THEN '"options":"o",' ELSE '' END || '"spec_version":1,"tool":"t","version":"' || label || '"}') AS tool_profile_hash FROM embeddings""")
def content_profiles(spark, sf_dir):
    """Identities of embeddings, chunking settings and tools."""
    e = load(spark, sf_dir, "embeddings")
    label = F.col("label").cast("string")
    ident = hashing.embedding_id_column(F.lit("chunk"), F.concat(F.lit("h"), F.col("vec_id").cast("string")), F.size("embedding"), F.lit("cosine"), F.lit("text"), F.lit("p"), F.when(F.col("label") % 2 == 0, F.concat(F.lit("c"), label)))
    return e.select("vec_id", ident.alias("embedding_id"), hashing.chunking_config_column(F.col("label") + 1000, F.lit("heading")).alias("config_hash"), hashing.tool_profile_column(F.lit("t"), label, F.when(F.col("label") % 3 == 0, "o")).alias("tool_profile_hash"))


@query("SELECT doc_id, 'sha256:' || sha256(nfc_normalize(text)) AS input_hash FROM documents")
def input_hashes(spark, sf_dir):
    """hashes of queries in NFC."""
    return load(spark, sf_dir, "documents").select("doc_id", hashing.input_hash("text").alias("input_hash"))


@query("SELECT page_id, 'sha256:' || sha256(url) AS text_hash, 'sha256:' || sha256(html) AS perceptual_hash, 'sha256:' || sha256(html) AS visual_hash, (octet_length(encode(html)) / 1e6::DOUBLE * 0.01::DOUBLE)::DOUBLE AS usd FROM pages")
def fingerprints(spark, sf_dir):
    """Fingerprints of units, and what local work on them is taken to cost."""
    f = hashing.fingerprint_column(F.col("url").cast("binary"), F.col("html").cast("binary"))
    return load(spark, sf_dir, "pages").select("page_id", f.alias("f"), ledger.local_cost(F.octet_length("html")).alias("usd")).select("page_id", "f.*", "usd")


@query("SELECT vec_id, len(embedding) * 4 AS bytes, round(list_sum(embedding::DOUBLE[]), 5) AS total, true AS same FROM embeddings")
def stored_vectors(spark, sf_dir):
    """vectors written as little-endian single floats, and read back."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", vectors.encoded("embedding").alias("data"))
    e = e.withColumn("back", vectors.decoded("data"))
    total = F.aggregate("back", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return e.select("vec_id", F.octet_length("data").cast("bigint").alias("bytes"), F.round(total, 5).alias("total"), (F.col("back") == F.col("embedding")).alias("same"))


@query("SELECT source, 'sha256:' || sha256('{\"max_per_raw_hash\":3,\"mmr_depth\":100,\"mmr_lambda\":0.7,\"query\":\"' || source || '\",\"scopes\":[{\"scope_id\":\"a\"},{\"scope_id\":\"b\"}]}') AS query_hash, CASE WHEN source < 'src5' THEN 'ok' ELSE 'the cursor is of another query' END AS verdict FROM (SELECT DISTINCT source FROM documents)")
def cursors(spark, sf_dir):
    """Requests hashed, and their cursors signed and checked; some come back with another query."""

    def run(batches):
        for b in batches:
            hashes, verdicts = [], []
            for source in b["source"]:
                own = evidence.query_hash(source, [{"scope_id": "b"}, {"scope_id": "a"}])
                token = evidence.encode_cursor({"query_hash": own, "consumed": 10}, b"key")
                expected = own if source < "src5" else evidence.query_hash(source + "?", [{"scope_id": "a"}])
                try:
                    verdicts.append("ok" if evidence.decode_cursor(token, b"key", expected)["consumed"] == 10 else "lost")
                except ValueError as e:
                    verdicts.append(str(e))
                hashes.append(own)
            yield b.assign(query_hash=hashes, verdict=verdicts)

    return load(spark, sf_dir, "documents").select("source").distinct().mapInPandas(run, "source string, query_hash string, verdict string")


# --- history ------------------------------------------------------------------------

TAGS = "t AS (SELECT 'v' || (row_number() OVER (ORDER BY day)) AS name, 'c-' || day AS commit_hash FROM (SELECT DISTINCT day FROM e) WHERE day < '2024-01-20')"


def tags_of(spark, sf_dir):
    from pyspark.sql import Window as W

    days = load(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct().where("day < '2024-01-20'")
    return days.select(F.concat(F.lit("v"), F.row_number().over(W.orderBy("day")).cast("string")).alias("name"), F.concat(F.lit("c-"), "day").alias("commit_hash"))


@query(HISTORY + ", " + TAGS + """, o AS (SELECT CASE s_suppkey % 6 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'V' || s_suppkey % 30 WHEN 2 THEN 'head' WHEN 3 THEN 'a/b' WHEN 4 THEN '' ELSE 'sha256:' || repeat('0', 64) END AS operand FROM supplier)
SELECT operand, count(*) AS n, max(CASE WHEN operand = 'HEAD' THEN (SELECT commit_hash FROM head) ELSE (SELECT t.commit_hash FROM t WHERE t.name = lower(operand)) END) AS commit_hash,
  max(CASE WHEN operand = 'HEAD' OR lower(operand) IN (SELECT name FROM t) THEN NULL WHEN operand = 'head' THEN 'reserved' WHEN operand = 'a/b' THEN 'path' WHEN operand = '' THEN 'empty' WHEN starts_with(operand, 'sha256:') THEN 'shallow' ELSE 'not_found' END) AS fault FROM o GROUP BY operand""")
def resolved_operands(spark, sf_dir):
    """What operands name: the head, a hash, a tag whatever its case."""
    n, _, head = commit_tables(spark, sf_dir)
    k = F.col("s_suppkey")
    operand = F.when(k % 6 == 0, "HEAD").when(k % 6 == 1, F.concat(F.lit("V"), (k % 30).cast("string"))).when(k % 6 == 2, "head").when(k % 6 == 3, "a/b").when(k % 6 == 4, "").otherwise("sha256:" + "0" * 64)
    o = load(spark, sf_dir, "supplier").select(operand.alias("operand"))
    got = refs.resolve(o.distinct(), tags_of(spark, sf_dir), n.select("commit_hash").distinct(), head.first()[0])
    return o.groupBy("operand").agg(F.count(F.lit(1)).alias("n")).join(got, "operand")


@query(HISTORY + ", " + TAGS + """, w AS (SELECT 'N' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'c-2024-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') WHEN s_suppkey % 3 = 1 THEN 'c-none' END AS c FROM supplier UNION ALL SELECT 'V' || s_suppkey % 20, NULL FROM supplier WHERE s_suppkey <= 20 UNION ALL SELECT 'HEAD', NULL),
x AS (SELECT name, coalesce(c, (SELECT commit_hash FROM head)) AS c FROM w)
SELECT name, CASE WHEN fault IS NULL THEN c END AS commit_hash, fault FROM (SELECT *, CASE WHEN name = 'HEAD' THEN 'reserved' WHEN c NOT IN (SELECT DISTINCT commit_hash FROM n) THEN 'commit_missing' WHEN lower(name) IN (SELECT name FROM t) THEN 'exists' END AS fault FROM x)""")
def new_tags(spark, sf_dir):
    """Wishes for tags, and why some are refused."""
    n, _, head = commit_tables(spark, sf_dir)
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    commit = F.when(k % 3 == 0, F.concat(F.lit("c-2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).when(k % 3 == 1, "c-none")
    w = s.select(F.concat(F.lit("N"), k.cast("string")).alias("name"), commit.alias("commit"))
    w = w.unionByName(s.where("s_suppkey <= 20").select(F.concat(F.lit("V"), (k % 20).cast("string")).alias("name"), F.lit(None).cast("string").alias("commit")))
    w = w.unionByName(spark.createDataFrame([("HEAD", None)], "name string, commit string"))
    return refs.tag(w, tags_of(spark, sf_dir), n.select("commit_hash").distinct(), head.first()[0])


@query(HISTORY + """, h AS (SELECT DISTINCT commit_hash AS hash FROM n UNION SELECT DISTINCT raw_hash FROM n UNION SELECT 'none'), o AS (SELECT DISTINCT 'sha256:' || sha256(event_type) AS hash, octet_length(encode(event_type))::BIGINT AS size FROM events WHERE event_type <> 'error')
SELECT hash, CASE WHEN c.commit_hash IS NOT NULL THEN 'commit' WHEN o.size IS NOT NULL THEN 'raw' END AS kind, coalesce(c.k, o.size) AS size FROM h LEFT JOIN (SELECT commit_hash, count(*) AS k FROM n GROUP BY 1) c ON c.commit_hash = h.hash LEFT JOIN o USING (hash)""")
def inspected(spark, sf_dir):
    """What a hash is: a commit with its entries, an object with its bytes, or unknown."""
    n, _, _ = commit_tables(spark, sf_dir)
    kinds = load(spark, sf_dir, "events").select("event_type").distinct()
    objects = kinds.where("event_type <> 'error'").select(hashing.content_hash(F.col("event_type")).alias("hash"), F.lit("raw").alias("kind"), F.col("event_type").cast("binary").alias("body"))
    hashes = n.select(F.col("commit_hash").alias("hash")).union(n.select("raw_hash")).union(spark.createDataFrame([("none",)], "hash string")).distinct()
    return refs.inspect(hashes, n.select("commit_hash").distinct(), n, objects)


@query(HISTORY + """, r AS (SELECT DISTINCT commit_hash FROM walk WHERE depth <= 12) SELECT raw_hash, substr(path, 6, 1)::BIGINT AS gen, count(DISTINCT commit_hash) AS commits FROM n WHERE commit_hash IN (SELECT commit_hash FROM r) GROUP BY ALL""")
def retained_instances(spark, sf_dir):
    """The instances that commits near the head pin."""
    n, parents, head = commit_tables(spark, sf_dir)
    n = n.withColumns({"tool_profile_hash": F.lit("t"), "gen": F.substring("path", 6, 1).cast("bigint")})
    return refs.retained_instances(n, history.reachable(head, parents).where("depth <= 12")).select("raw_hash", "gen", "commits")


@query("SELECT 'doc:' || doc_id AS unit_key, CASE WHEN NOT contains(text, '#') AND length(text) <= 6000 THEN octet_length(encode(text))::BIGINT ELSE -1 END AS bytes FROM documents WHERE doc_id % 3 = 0 AND doc_id % 9 <> 0 AND length(trim(text)) > 0")
def reindexed(spark, sf_dir):
    """Whole documents that one commit pins and the collection lacks; the bytes of those that are one chunk, -1 for others."""
    d = load(spark, sf_dir, "documents")
    units_ = d.select(hashing.content_hash(F.concat("text", F.col("doc_id").cast("string")).cast("binary")).alias("raw_hash"), F.lit("t").alias("tool_profile_hash"), F.lit(1).cast("bigint").alias("gen"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("unit_key"), "text", "doc_id")
    entries = units_.select(F.when(F.col("doc_id") % 3 == 0, "c1").otherwise("c2").alias("commit_hash"), "raw_hash", "tool_profile_hash", "gen")
    there = chunking.chunk(units_.where("doc_id % 9 = 0"))
    made = refs.reindex_at("c1", entries, units_, there).groupBy("unit_key").agg(F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"))
    plain = units_.select("unit_key", (~F.contains("text", F.lit("#")) & (F.length("text") <= 6000)).alias("plain"))
    return made.join(plain, "unit_key").select("unit_key", F.when(F.col("plain"), F.col("bytes")).otherwise(F.lit(-1)).alias("bytes"))


@query(HISTORY + """, i AS (SELECT commit_hash, path, raw_hash FROM n WHERE NOT EXISTS (SELECT 1 FROM p JOIN n m ON m.commit_hash = p.parent WHERE p.commit_hash = n.commit_hash AND m.path = n.path AND m.raw_hash = n.raw_hash)),
up AS (SELECT commit_hash AS start, parent AS a FROM p UNION SELECT up.start, p.parent FROM up JOIN p ON p.commit_hash = up.a),
k AS (SELECT path, raw_hash, min(commit_hash) AS pointer_commit FROM i WHERE NOT EXISTS (SELECT 1 FROM up JOIN i j ON j.commit_hash = up.a WHERE up.start = i.commit_hash AND j.path = i.path AND j.raw_hash = i.raw_hash) GROUP BY path, raw_hash)
SELECT DISTINCT n.path, n.raw_hash, k.pointer_commit, EXISTS (SELECT 1 FROM n l WHERE l.commit_hash = (SELECT commit_hash FROM head) AND l.path = n.path AND l.raw_hash = n.raw_hash) AS is_live FROM n JOIN walk USING (commit_hash) JOIN k ON k.path = n.path AND k.raw_hash = n.raw_hash""")
def all_history(spark, sf_dir):
    """H1 H3: every binding that the head reaches, with its canonical introduction as pointer."""
    n, parents, head = commit_tables(spark, sf_dir)
    return history.all_bindings(head, parents, n, ["path", "raw_hash"])


@query(HISTORY + ", s AS (SELECT DISTINCT commit_hash, depth FROM walk) SELECT count(DISTINCT commit_hash) FILTER (commit_hash NOT IN ('c-2024-01-05', 'c-2024-01-11')) AS present, count(DISTINCT commit_hash) FILTER (commit_hash IN ('c-2024-01-05', 'c-2024-01-11')) AS skipped FROM s")
def shallow_walk(spark, sf_dir):
    """H8: ancestors without a tree are skipped and counted."""
    n, parents, head = commit_tables(spark, sf_dir)
    there, shallow = history.present(history.reachable(head, parents), n.where("commit_hash not in ('c-2024-01-05', 'c-2024-01-11')"))
    return there.agg(F.count_distinct("commit_hash").alias("present")).crossJoin(shallow.agg(F.count_distinct("commit_hash").alias("skipped")))


@query(HISTORY + ", a AS (SELECT path, raw_hash AS old_hash FROM n WHERE commit_hash = (SELECT commit_hash FROM head)), b AS (SELECT path, CASE WHEN substr(path, -1) = '3' THEN 'sha256:x' ELSE raw_hash END AS new_hash FROM n WHERE commit_hash = (SELECT commit_hash FROM head) AND substr(path, -1) <> '7') SELECT coalesce(a.path, b.path) AS path, old_hash, new_hash, CASE WHEN new_hash IS NULL THEN 'deleted' ELSE 'modified' END AS state FROM a FULL JOIN b ON a.path = b.path WHERE old_hash IS DISTINCT FROM new_hash")
def working_status(spark, sf_dir):
    """What differs between the head and the folder."""
    n, _, head = commit_tables(spark, sf_dir)
    tree = n.join(head, "commit_hash", "left_semi").select("path", "raw_hash")
    working = tree.where("not endswith(path, '7')").withColumn("raw_hash", F.when(F.endswith("path", F.lit("3")), "sha256:x").otherwise(F.col("raw_hash")))
    return refs.status(tree, working)


@query("""WITH c AS (SELECT conv_id, turn, sha256(text) AS f FROM conversations), o AS (SELECT conv_id, list(f ORDER BY turn) AS a FROM c GROUP BY 1),
w AS (SELECT conv_id, list(f ORDER BY turn) AS b FROM (SELECT conv_id, turn, CASE WHEN turn = 1 THEN f || 'x' ELSE f END AS f FROM c) GROUP BY 1)
SELECT conv_id AS doc, len(a) - (len(a) > 1)::INT AS unchanged, (len(a) > 1)::INT AS changed, 0 AS added, 0 AS removed, (len(a) > 1)::INT::DOUBLE / len(a) AS change_rate FROM o JOIN w USING (conv_id)""")
def change_rates(spark, sf_dir):
    """Conversations of which the second turn was edited."""
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("unit"), F.sha2("text", 256).alias("fingerprint"))
    return units.change_rates(units.map_units(c, c.withColumn("fingerprint", F.when(F.col("ord") == 1, F.concat("fingerprint", F.lit("x"))).otherwise(F.col("fingerprint")))))


# --- tasks, submission, sweeps ------------------------------------------------------


@query("""WITH t AS (SELECT o_orderkey, ['pending', 'running', 'failed', 'paused', 'done'][o_orderkey % 5 + 1] AS status, ['network_error', 'rate_limit', 'auth_error', 'quota_exceeded', 'invalid_input', 'budget_exceeded', 'secrets_tier_b', 'odd', NULL][o_custkey % 9 + 1] AS reason, o_custkey % 6 AS attempts, CASE WHEN o_custkey % 2 = 0 THEN 'embedding' ELSE 'markdownize' END AS kind FROM orders),
k AS (SELECT *, CASE WHEN reason IN ('network_error', 'rate_limit', 'auth_error', 'quota_exceeded', 'invalid_input', 'budget_exceeded') THEN reason ELSE 'contract_violation' END AS retry_kind FROM t),
a AS (SELECT *, CASE retry_kind WHEN 'network_error' THEN attempts < 5 WHEN 'rate_limit' THEN true WHEN 'quota_exceeded' THEN attempts < 3 WHEN 'contract_violation' THEN attempts < 1 ELSE false END AS retry_allowed FROM k)
SELECT o_orderkey, retry_kind, retry_allowed, status = 'failed' AND NOT retry_allowed AS terminal, CASE WHEN status = 'paused' THEN CASE reason WHEN 'budget_exceeded' THEN 'budget' WHEN 'secrets_tier_b' THEN 'tier_b_approval' WHEN 'auth_error' THEN 'auth' END END AS hold,
  kind = 'embedding' AND status = 'pending' AS can_hold_secret, status IN ('pending', 'running', 'failed') OR (status = 'paused' AND coalesce(reason IN ('budget_exceeded', 'auth_error'), false)) AS can_complete, status = 'paused' AND retry_kind = 'auth_error' AS can_resume FROM a""")
def task_transitions(spark, sf_dir):
    """Retries, holds and completions that each task allows."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda some, i: F.element_at(F.array(*map(F.lit, some)), (i + 1).cast("int"))
    t = load(spark, sf_dir, "orders").select(k, pick(["pending", "running", "failed", "paused", "done"], k % 5).alias("status"), pick(["network_error", "rate_limit", "auth_error", "quota_exceeded", "invalid_input", "budget_exceeded", "secrets_tier_b", "odd", None], c % 9).alias("reason"), (c % 6).alias("attempts"), F.when(c % 2 == 0, "embedding").otherwise("markdownize").alias("type"))
    return tasks.task_rules(t).select("o_orderkey", "retry_kind", "retry_allowed", "terminal", "hold", "can_hold_secret", "can_complete", "can_resume")


@query("""WITH live AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 4 <> 3), w AS (SELECT o_custkey AS k, o_orderkey AS made, o_totalprice AS usd FROM orders WHERE o_orderkey % 10 <> 0)
SELECT k::VARCHAR AS idempotency_key, arg_min(usd, made) AS estimated_usd, min(made) AS created_at, 0 AS state FROM w WHERE k NOT IN (SELECT k FROM live) GROUP BY k""")
def reservations(spark, sf_dir):
    """The first phase, one reservation a key that has none under way."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("idempotency_key"), F.col("o_orderkey").alias("created_at"), F.col("o_totalprice").alias("estimated_usd"))
    held = o.where("created_at % 10 = 0").select("idempotency_key", (F.col("created_at") % 4).alias("state"))
    return tasks.reserve(held, o.where("created_at % 10 <> 0"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 4 AS state FROM orders), a AS (SELECT o_orderkey AS k, ['submitted', 'done', 'rejected'][o_custkey % 3 + 1] AS a, o_totalprice AS usd FROM orders WHERE o_custkey % 5 <> 0),
b AS (SELECT o_orderkey AS k, ['done', 'rejected'][o_orderkey // 4 % 2 + 1] AS b, 2 * o_totalprice AS usd FROM orders WHERE o_custkey % 2 = 0),
s AS (SELECT r.k, state, a.usd AS first_usd, b.usd AS second_usd, b, CASE WHEN state = 0 AND a = 'submitted' THEN 1 WHEN state = 1 AND a = 'done' THEN 2 WHEN state IN (0, 1) AND a = 'rejected' THEN 3 ELSE state END AS mid FROM r LEFT JOIN a USING (k) LEFT JOIN b USING (k)),
n AS (SELECT *, CASE WHEN mid = 1 AND b = 'done' THEN 2 WHEN mid IN (0, 1) AND b = 'rejected' THEN 3 ELSE mid END AS next FROM s)
SELECT k AS idempotency_key, state, next::INT AS next, CASE WHEN next = 3 THEN 0.0 WHEN next = 2 AND mid <> 2 THEN second_usd WHEN next = 2 AND state <> 2 THEN first_usd END AS cost_usd FROM n""")
def settlements(spark, sf_dir):
    """The second phase, what up to two outcomes in order make of requests."""
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    pick = lambda some, i: F.element_at(F.array(*map(F.lit, some)), (i + 1).cast("int"))
    first = o.where("o_custkey % 5 <> 0").select(k.alias("idempotency_key"), F.lit(1).alias("seq"), pick(["submitted", "done", "rejected"], F.col("o_custkey") % 3).alias("outcome"), F.col("o_totalprice").alias("usd"))
    second = o.where("o_custkey % 2 = 0").select(k.alias("idempotency_key"), F.lit(2).alias("seq"), pick(["done", "rejected"], F.floor(k / 4) % 2).alias("outcome"), (2 * F.col("o_totalprice")).alias("usd"))
    got = tasks.settle(o.select(k.alias("idempotency_key"), (k % 4).alias("state")), first.unionByName(second))
    return got.select("idempotency_key", "state", F.col("next").cast("int").alias("next"), "cost_usd")


@query("""WITH c AS (SELECT event_id, event_id % 500 AS tree FROM events WHERE event_type <> 'view'), r AS (SELECT event_id FROM events WHERE event_id % 2 = 0), t AS (SELECT DISTINCT event_id % 500 AS tree FROM events WHERE event_id % 3 <> 0 AND event_id % 500 <> event_id % 7 * 71)
SELECT event_id, phase, CASE phase WHEN 'marked' THEN 'write_receipt' WHEN 'receipted' THEN 'unlink_tree' END AS next_step FROM (SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM r) AND tree NOT IN (SELECT tree FROM t) THEN 'done' WHEN event_id IN (SELECT event_id FROM r) THEN 'receipted' WHEN tree IN (SELECT tree FROM t) THEN 'marked' ELSE 'broken' END AS phase FROM c)""")
def sweep_progress(spark, sf_dir):
    """L2: how far a sweep has come, told by receipts and trees."""
    e, i = load(spark, sf_dir, "events"), F.col("event_id")
    plan = e.where("event_type <> 'view'").select(i.alias("commit_hash"), (i % 500).alias("tree_hash"))
    trees = e.where("event_id % 3 <> 0 and event_id % 500 <> event_id % 7 * 71").select((i % 500).alias("tree_hash"))
    return tasks.sweep_progress(plan, e.where("event_id % 2 = 0").select(i.alias("commit_hash")), trees).select(F.col("commit_hash").alias("event_id"), "phase", "next_step")


# --- registries, logs, reports ------------------------------------------------------


@query("""WITH r AS (SELECT user_id AS scope_id, 'p' || (event_id % 120) AS path, event_id AS seen, event_type <> 'error' AS searchable FROM events), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY seen DESC) AS k FROM r) WHERE k = 1)
SELECT scope_id, path, seen FROM l WHERE searchable AND seen = (SELECT max(seen) FROM l m WHERE m.path = l.path) AND scope_id % 10 <> 4""")
def registry_targets(spark, sf_dir):
    """Scopes to search, the last entry of each, stale paths and removed scopes left out."""
    r = load(spark, sf_dir, "events").select(F.col("user_id").alias("scope_id"), F.concat(F.lit("p"), (F.col("event_id") % 120).cast("string")).alias("path"), F.col("event_id").alias("seen"), (F.col("event_type") != "error").alias("searchable"))
    gone = r.where("scope_id % 10 = 4").select("scope_id")
    return stores.removed(stores.search_targets(r), gone).select("scope_id", "path", "seen")


@query("SELECT user_id AS scope_id, count(DISTINCT event_type) AS paths FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def registry_duplicates(spark, sf_dir):
    """Scopes that several paths claim."""
    return stores.duplicates(load(spark, sf_dir, "events").select(F.col("user_id").alias("scope_id"), F.col("event_type").alias("path")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id")
def replayed_log(spark, sf_dir):
    """A log appended to twice, rewritten without some records, and replayed."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    path = f"{stores.shared_folder(spark)}/log-{uuid.uuid4().hex}"
    stores.append_log(e.where("event_id % 2 = 0"), path)
    stores.append_log(e.where("event_id % 2 = 1"), path)
    schema = "user_id bigint, event_type string, event_id bigint"
    stores.rewrite_log(spark, path, schema, F.col("event_type") != "error")
    return stores.latest(stores.read_log(spark, path, schema), ["user_id"], "event_id")


@query("""WITH r AS (SELECT o_orderkey AS q, 'M' || o_custkey % 4 AS scenario, CASE o_orderkey % 10 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'timeout' ELSE 'ok' END AS outcome, (o_orderkey % 5) / 4.0 AS recall, o_totalprice AS ms FROM orders),
s AS (SELECT *, CASE outcome WHEN 'ok' THEN 'scored' WHEN 'unsupported' THEN 'not_implemented' ELSE 'failed' END AS status, CASE outcome WHEN 'ok' THEN recall WHEN 'unsupported' THEN NULL ELSE 0.0 END AS counted FROM r)
SELECT scenario, count(*) AS n, count(*) FILTER (status = 'scored') AS scored, round(avg(counted), 6) AS mean_recall, quantile_disc(ms, 0.95) FILTER (status = 'scored') AS p95, avg(counted) >= 0.45 AS passed FROM s GROUP BY scenario""")
def scenario_report(spark, sf_dir):
    """Golden queries by scenario: status, mean recall, latency and verdict."""
    k = F.col("o_orderkey")
    r = load(spark, sf_dir, "orders").select(k.alias("query_id"), F.concat(F.lit("M"), (F.col("o_custkey") % 4).cast("string")).alias("scenario"), F.when(k % 10 == 0, "unsupported").when(k % 10 == 1, "timeout").otherwise("ok").alias("outcome"), (k % 5 / 4.0).alias("recall"), F.col("o_totalprice").alias("latency_ms"))
    return evaluation.golden_run(r, 0.45)[1].withColumn("mean_recall", F.round("mean_recall", 6))


@query("""WITH m AS (SELECT o_orderkey AS r, i, CASE WHEN (o_orderkey + i) % 23 = 0 THEN 'blocked' WHEN (o_orderkey * i) % 7 = 5 THEN 'not-measured' ELSE 'measured' END AS state, o_custkey * (i + 1) AS value FROM orders, range(4) t(i)),
g AS (SELECT r, bool_or(state = 'blocked') AS b, count(*) FILTER (state = 'measured') AS n, max(CASE WHEN state = 'measured' THEN value END) FILTER (i = 2) AS preview, max(CASE WHEN state = 'measured' THEN value END) FILTER (i = 3) AS actual FROM m GROUP BY r)
SELECT r AS report_id, CASE WHEN b THEN 'blocked' WHEN n = 4 THEN 'measured' ELSE 'not-measured' END AS assessment, CASE WHEN NOT b AND n = 4 AND preview > 0 THEN actual::DOUBLE / preview END AS cost_ratio FROM g""")
def value_reports(spark, sf_dir):
    """Reports of time to first value and cost, with what was not measured or was blocked."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.posexplode(F.array(*map(F.lit, evaluation.MEASURES))).alias("i", "measure"))
    k, i = F.col("o_orderkey"), F.col("i")
    state = F.when((k + i) % 23 == 0, "blocked").when((k * i) % 7 == 5, "not-measured").otherwise("measured")
    m = o.select(k.alias("report_id"), "measure", state.alias("state"), F.when(state == "measured", F.col("o_custkey") * (i + 1)).alias("value"), F.when(state != "measured", "none yet").alias("reason"))
    return evaluation.assessments(m).select("report_id", "assessment", "cost_ratio")


@query("""SELECT item_id, ['sha256:' || sha256(text), 'sha256:' || sha256('x' || item_id)] AS images, CASE WHEN item_id % 3 = 0 THEN 'y' || item_id ELSE 's' || item_id END AS leaf FROM benchmark""")
def related_images(spark, sf_dir):
    """Images that Markdown cites, once each and in order, and the last part of a section's id."""
    i = F.col("item_id").cast("string")
    cite = lambda x, scheme="evidence": F.concat(F.lit(f"![a b]({scheme}://s/object/image/sha256:"), F.sha2(x, 256), F.lit(")\n"))
    markdown = F.concat(cite(F.col("text")), F.lit("words "), cite(F.concat(F.lit("x"), i)), cite(F.col("text")), cite(i, "other"), F.lit("![](evidence://s/object/image/sha256:short)"))
    section = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("x/y"), i)).when(F.col("item_id") % 3 == 1, "")
    return load(spark, sf_dir, "benchmark").select("item_id", text.related_images(markdown, "evidence").alias("images"), text.leaf_section(section, F.concat(F.lit("s"), i)).alias("leaf"))


@query("SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS units FROM part")
def query_units(spark, sf_dir):
    """R2: tokens of queries, each once."""

    def run(batches):
        for b in batches:
            yield b[["p_partkey"]].assign(units=[sorted(text.query_units(q)) for q in b["p_name"]])

    return load(spark, sf_dir, "part").select("p_partkey", "p_name").mapInPandas(run, "p_partkey bigint, units array<string>")
