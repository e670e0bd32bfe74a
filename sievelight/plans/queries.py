"""Registered queries over the test tables, each with its SQL where SQL can say it.

documents stand for chunks (source is the scope), embeddings for vectors, days of
events for commits, orders for ledger rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing, text, vectors
from ..operators import chunking, eligibility, evaluation, evidence, history, index, ledger, lifecycle, search, units
from ..sources import scan, stores
from . import fixture

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

PHRASES = ["licensed under", "idiot"]
NOW = 1_706_659_200  # 2024-01-31, the day after the last event
RULES = ["src1*", "!src12", "*7", "tmp/"]
QUERY_ID = 0


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("scope_id"), F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("chunk_id"), hashing.content_hash(F.col("text").cast("binary")).alias("raw_hash"), F.lit("[]").alias("heading_path"), "text")


def text_index(spark: SparkSession, sf_dir: str) -> index.TextIndex:
    """The index of the documents as they are now, written on first use."""
    return index.TextIndex.of(spark, lambda: corpus(spark, sf_dir), index.state_of(spark, f"{sf_dir}/documents.parquet"))


CORPUS = """c AS (SELECT source AS scope_id, lpad(doc_id::VARCHAR, 10, '0') AS chunk_id, 'sha256:' || sha256(text) AS raw_hash, text FROM documents)"""

BM25 = (
    "WITH "
    + CORPUS
    + """,
f AS (SELECT scope_id, chunk_id, raw_hash, (greatest(0, length(text) - 2))::DOUBLE AS size,
  ((length(text) - length(replace(lower(text), 'licensed under', ''))) / 14)::DOUBLE AS f0,
  ((length(text) - length(replace(lower(text), 'idiot', ''))) / 5)::DOUBLE AS f1 FROM c),
s AS (SELECT count(*) AS n, sum(size) / count(*) AS mean, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM f),
i AS (SELECT *, CASE WHEN ln((n - n0 + 0.5) / (n0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n0 + 0.5) / (n0 + 0.5)) END AS i0,
  CASE WHEN ln((n - n1 + 0.5) / (n1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n1 + 0.5) / (n1 + 0.5)) END AS i1 FROM s),
b AS (SELECT scope_id, chunk_id, raw_hash, - i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * size / mean)) - i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * size / mean)) AS bm25 FROM f, i WHERE f0 > 0 OR f1 > 0)
"""
)


@query(BM25 + "SELECT scope_id, chunk_id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY bm25, scope_id, chunk_id)::INT AS rank FROM b ORDER BY rank LIMIT 10")
def bm25_top10(spark, sf_dir):
    """Global BM25 over trigram phrases."""
    return text_index(spark, sf_dir).bm25(PHRASES, depth=10).drop("raw_hash").withColumn("bm25", F.round("bm25", 6))


@query(BM25 + "SELECT scope_id, chunk_id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY bm25, scope_id, chunk_id)::INT AS rank FROM b WHERE scope_id IN ('src1', 'src2', 'src3') ORDER BY rank LIMIT 200")
def bm25_in_scopes(spark, sf_dir):
    """Rows are restricted before the cut, statistics are not."""
    found = text_index(spark, sf_dir)
    eligible = found.docs.where("scope_id in ('src1', 'src2', 'src3')").select("scope_id", "chunk_id")
    return found.bm25(PHRASES, eligible).drop("raw_hash").withColumn("bm25", F.round("bm25", 6))


@query("WITH " + CORPUS + "SELECT scope_id, chunk_id, strpos(text, 'is')::INT AS position, row_number() OVER (ORDER BY strpos(text, 'is'), scope_id, chunk_id)::INT AS rank, 0.0::DOUBLE AS bm25 FROM c WHERE contains(text, 'is') AND (contains(text, 'to') OR contains(text, 'To')) ORDER BY rank LIMIT 200".replace("SELECT scope_id", " SELECT scope_id", 1))
def short_tokens(spark, sf_dir):
    """Tokens too short for trigrams."""
    return search.short_lane(corpus(spark, sf_dir), [["is"], ["to", "To"]]).select("scope_id", "chunk_id", "position", "rank", "bm25")


def vector_table(spark, sf_dir):
    """Vectors of the documents' chunks; some belong to images that the chunks cite."""
    e, d = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    image = F.when(F.col("label") == 9, F.concat(F.lit("img"), (F.col("vec_id") % 7).cast("string")))
    return e.join(d, "vec_id", "left").select(F.coalesce("source", F.lit("none")).alias("scope_id"), F.lpad(F.col("vec_id").cast("string"), 10, "0").alias("chunk_id"), image.alias("image_id"), F.col("embedding").alias("vector"))


def query_vector(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ID).first().embedding


VECTORS = """v AS (SELECT coalesce(source, 'none') AS scope_id, lpad(vec_id::VARCHAR, 10, '0') AS chunk_id, CASE WHEN label = 9 THEN 'img' || (vec_id % 7) END AS image_id, embedding::DOUBLE[] AS vector FROM embeddings LEFT JOIN documents ON vec_id = doc_id),
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
fi AS (SELECT *, row_number() OVER (PARTITION BY scope_id, image_id ORDER BY chunk_id) AS nth FROM v),
vr AS (SELECT scope_id, chunk_id, image_id, list_cosine_similarity(vector, q) AS cosine FROM fi, q WHERE image_id IS NULL OR nth = 1),
vl AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, scope_id, coalesce(image_id, chunk_id), chunk_id)::INT AS rank FROM vr ORDER BY rank LIMIT 200)"""


@query("WITH " + VECTORS + " SELECT scope_id, chunk_id, image_id, round(cosine, 6) AS cosine, rank FROM vl")
def vector_lane(spark, sf_dir):
    """Exact cosines of chunks and images in one ranking."""
    return search.vector_lane(vector_table(spark, sf_dir), query_vector(spark, sf_dir)).withColumn("cosine", F.round("cosine", 6))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS cosine, row_number() OVER (ORDER BY list_cosine_similarity(e, q) DESC, vec_id)::INT AS rank FROM v, q ORDER BY rank LIMIT 10")
def cosine_top10(spark, sf_dir):
    """O2: brute-force neighbours."""
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, sf_dir)])
    rows = load(spark, sf_dir, "embeddings").select("vec_id", vectors.rank_cosine(F.col("embedding"), q).alias("cosine")).where("cosine is not null")
    return search.top(rows, 10, F.desc("cosine"), "vec_id").withColumn("cosine", F.round("cosine", 6))


def lanes(spark, sf_dir):
    """Both lanes, 200 rows each at most, computed once and side by side."""
    return search.together(spark, lambda: text_index(spark, sf_dir).bm25(PHRASES), lambda: search.vector_lane(vector_table(spark, sf_dir), query_vector(spark, sf_dir)))


def fused(spark, sf_dir):
    """The fused rows with the hash of their document and their vector; only the documents of these rows are looked up."""
    f = search.fuse(*lanes(spark, sf_dir))
    keys = F.broadcast(f.select("scope_id", "chunk_id").distinct())  # of 400 rows at most
    c = text_index(spark, sf_dir).docs.join(keys, ["scope_id", "chunk_id"], "left_semi").select("scope_id", "chunk_id", "raw_hash")
    e = vector_table(spark, sf_dir).join(keys, ["scope_id", "chunk_id"], "left_semi").select("scope_id", "chunk_id", "vector")
    return f.join(c, ["scope_id", "chunk_id"], "left").join(e, ["scope_id", "chunk_id"], "left")


FUSED = (
    BM25.rstrip()
    + """,
t AS (SELECT scope_id, chunk_id, row_number() OVER (ORDER BY bm25, scope_id, chunk_id) AS rank FROM b ORDER BY rank LIMIT 200),
"""
    + VECTORS
    + """,
u AS (SELECT coalesce(t.scope_id, w.scope_id) AS scope_id, coalesce(t.chunk_id, w.chunk_id) AS chunk_id, NULL::VARCHAR AS image_id, t.rank AS text_rank, w.rank AS vector_rank FROM t FULL JOIN (SELECT * FROM vl WHERE image_id IS NULL) w ON t.scope_id = w.scope_id AND t.chunk_id = w.chunk_id
  UNION ALL SELECT w.scope_id, w.chunk_id, w.image_id, t.rank, w.rank FROM vl w LEFT JOIN t ON t.scope_id = w.scope_id AND t.chunk_id = w.chunk_id WHERE w.image_id IS NOT NULL),
y AS (SELECT *, coalesce(1.0::DOUBLE / (60 + text_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS score FROM u),
r AS (SELECT y.scope_id, y.chunk_id, y.image_id, text_rank::INT AS text_rank, vector_rank::INT AS vector_rank, score, c.raw_hash, row_number() OVER (ORDER BY score DESC, y.chunk_id, y.scope_id, y.image_id NULLS FIRST)::INT AS rank FROM y LEFT JOIN c ON c.chunk_id = y.chunk_id AND c.scope_id = y.scope_id)
"""
)


@query(FUSED + "SELECT scope_id, chunk_id, image_id, text_rank, vector_rank, round(score, 9) AS score, rank FROM r")
def hybrid_rrf(spark, sf_dir):
    """Both lanes fused by reciprocal ranks."""
    return search.fuse(*lanes(spark, sf_dir)).select("scope_id", "chunk_id", "image_id", "text_rank", "vector_rank", F.round("score", 9).alias("score"), "rank")


@query(FUSED + ", n AS (SELECT *, row_number() OVER (PARTITION BY raw_hash ORDER BY rank) AS nth FROM r WHERE raw_hash IS NOT NULL) SELECT chunk_id, raw_hash, row_number() OVER (ORDER BY rank)::INT AS rank FROM n WHERE nth <= 1")
def capped_per_document(spark, sf_dir):
    """No more than one row of each document."""
    return search.cap_per_document(fused(spark, sf_dir).where("raw_hash is not null"), 1).select("chunk_id", "raw_hash", "rank")


@query(FUSED + ", n AS (SELECT *, row_number() OVER (PARTITION BY scope_id, raw_hash ORDER BY rank) AS nth FROM r WHERE raw_hash IS NOT NULL), g AS (SELECT chunk_id, scope_id, raw_hash, row_number() OVER (ORDER BY rank)::INT AS rank FROM n WHERE nth = 1) SELECT * FROM g WHERE rank > 5 AND rank <= 25")
def documents_page(spark, sf_dir):
    """One row per document and scope, the second page."""
    rows = fused(spark, sf_dir).where("raw_hash is not null")
    return search.page(search.group_documents(rows).select("chunk_id", "scope_id", "raw_hash", "rank"), 5, 20)


@query(FUSED + ", p AS (SELECT doc_id, source AS scope_id, lpad(doc_id::VARCHAR, 10, '0') AS chunk_id FROM documents), a AS (SELECT scope_id, chunk_id, 'a/' || doc_id AS path, 'c1' AS commit_hash FROM p UNION ALL SELECT scope_id, chunk_id, 'b/' || doc_id, 'c2' FROM p WHERE doc_id % 2 = 0) SELECT r.chunk_id, r.image_id, a.path, a.commit_hash, round(score, 9) AS score, row_number() OVER (ORDER BY rank, r.scope_id, r.chunk_id, path, commit_hash)::INT AS row FROM r JOIN a ON a.chunk_id = r.chunk_id AND a.scope_id = r.scope_id")
def alias_rows(spark, sf_dir):
    """Results expanded to their bindings."""
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("scope_id"), F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("chunk_id"), "doc_id")
    a = d.select("scope_id", "chunk_id", F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), F.lit("c1").alias("commit_hash"))
    b = d.where("doc_id % 2 = 0").select("scope_id", "chunk_id", F.concat(F.lit("b/"), F.col("doc_id").cast("string")).alias("path"), F.lit("c2").alias("commit_hash"))
    rows = search.expand_aliases(search.fuse(*lanes(spark, sf_dir)), a.unionByName(b))
    return rows.select("chunk_id", "image_id", "path", "commit_hash", F.round("score", 9).alias("score"), "row")


@query()
def mmr_diversified(spark, sf_dir):
    """Greedy diversification of the fused vector candidates."""
    rows = fused(spark, sf_dir).where("vector is not null").withColumn("raw_hash", F.coalesce("raw_hash", "chunk_id"))
    rows = rows.select("chunk_id", "raw_hash", "score", "vector", "rank")
    return search.diversify(rows, by=[]).select("chunk_id", "raw_hash", F.round("score", 9).alias("score"), "rank")


@query(FUSED + ", o AS (SELECT rank, row_number() OVER (ORDER BY md5(chunk_id || coalesce(image_id, '')), rank)::INT AS new_rank FROM r WHERE rank <= 50) SELECT r.chunk_id, r.image_id, row_number() OVER (ORDER BY new_rank IS NULL, new_rank, r.rank)::INT AS rank FROM r LEFT JOIN o ON o.rank = r.rank")
def reranked(spark, sf_dir):
    """An order from outside for the head, the tail as it was."""
    f = search.fuse(*lanes(spark, sf_dir)).select("chunk_id", "image_id", "rank").withColumn("place", F.col("rank"))
    mixed = F.md5(F.concat("chunk_id", F.coalesce("image_id", F.lit(""))))
    order = f.where("rank <= 50").select("place", F.row_number().over(W.orderBy(mixed, "rank")).alias("new_rank"))
    return search.rerank(f, order, ["place"]).drop("place")


@query("WITH " + CORPUS + " SELECT scope_id, chunk_id FROM c WHERE scope_id NOT IN ('src3', 'src4')")
def purge_barrier(spark, sf_dir):
    """No candidates of scopes that are being purged."""
    purges = spark.createDataFrame([("src3",), ("src4",), ("src4",)], "scope_id string")
    return search.without_purged(corpus(spark, sf_dir).select("scope_id", "chunk_id"), purges)


# --- identity, text rules -----------------------------------------------------------


@query("SELECT doc_id, 'sha256:' || sha256(text) AS raw_hash, substr(sha256('doc:' || doc_id), 1, 16) AS unit_ref, 'sha256:' || sha256('{\"byte_end\":' || octet_length(encode(text)) || ',\"byte_start\":0,\"gen\":1,\"heading_path\":[\"' || source || '\"],\"raw_hash\":\"sha256:' || sha256(text) || '\",\"spec_version\":1,\"tool_profile_hash\":\"p\",\"unit_content_hash\":\"sha256:' || sha256(text) || '\",\"unit_key\":\"doc:' || doc_id || '\"}') AS chunk_id FROM documents")
def content_ids(spark, sf_dir):
    """Hashes and chunk ids from canonical JSON."""
    d = load(spark, sf_dir, "documents")
    raw = hashing.content_hash(F.col("text").cast("binary"))
    key = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    ident = hashing.chunk_id_column(raw, F.lit("p"), F.lit(1), key, raw, F.array("source"), F.lit(0), F.octet_length("text"), F.lit(""))
    return d.select("doc_id", raw.alias("raw_hash"), hashing.unit_ref(key).alias("unit_ref"), ident.alias("chunk_id"))


@query("SELECT doc_id, 'sha256:' || sha256(sha256(text) || chr(0) || source) AS idempotency_key FROM documents")
def idempotency_keys(spark, sf_dir):
    """F8."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", hashing.idempotency_key(F.sha2("text", 256), F.col("source")).alias("idempotency_key"))


TIERS = """WITH n AS (SELECT c_custkey, ['', '.ssh/', 'a/.aws/', '/.kube/'][c_custkey % 4 + 1] || ['', '.env', 'id_rsa', 'my'][c_custkey % 5 % 4 + 1] || lower(c_mktsegment) || ['', '.pem', '_token.txt', '.key', '.TFSTATE', '.tfstate.1'][c_custkey % 6 + 1] AS path FROM customer),
x AS (SELECT *, lower(ltrim(path, '/')) AS p, regexp_extract(lower(path), '[^/]*$') AS name FROM n)
SELECT c_custkey, path, CASE WHEN regexp_matches(p, '^\\.(ssh|gnupg|aws|kube|docker)/') OR name IN ('.env', '.ssh', '.gnupg', '.aws', '.kube', '.docker', '.netrc', '.npmrc', '.pypirc') OR regexp_matches(name, '^(\\.env\\.|id_rsa|id_ecdsa|id_ed25519)') OR regexp_matches(name, '\\.(pem|key|p12|pfx|keystore|tfstate)$') OR contains(name, '.tfstate.') THEN 'A'
  WHEN regexp_matches(name, 'credentials|secret|token|apikey|password') THEN 'B' END AS tier FROM x"""


@query(TIERS)
def secret_tiers(spark, sf_dir):
    """Secrets by path and name."""
    k = F.col("c_custkey")
    pick = lambda some, i: F.element_at(F.array(*map(F.lit, some)), (i + 1).cast("int"))
    path = F.concat(pick(["", ".ssh/", "a/.aws/", "/.kube/"], k % 4), pick(["", ".env", "id_rsa", "my"], k % 5 % 4), F.lower("c_mktsegment"), pick(["", ".pem", "_token.txt", ".key", ".TFSTATE", ".tfstate.1"], k % 6))
    return load(spark, sf_dir, "customer").select(k, path.alias("path")).withColumn("tier", scan.secret_tier(F.col("path")))


@query("SELECT source, CASE WHEN regexp_matches(source, '7$') THEN true WHEN source = 'src12' THEN false WHEN regexp_matches(source, '^src1[^/]*$') THEN true ELSE false END AS ignored FROM (SELECT DISTINCT source FROM documents)")
def ignore_rules(spark, sf_dir):
    """The last rule that matches wins."""
    s = load(spark, sf_dir, "documents").select("source").distinct()
    return s.select("source", scan.ignored(F.col("source"), F.lit(False), RULES).alias("ignored"))


@query("SELECT source, source = 'src1' AS exact, source = 'src1' OR starts_with(source, 'src1/') AS below FROM (SELECT DISTINCT source FROM documents)")
def scope_selection(spark, sf_dir):
    """P10."""
    s = load(spark, sf_dir, "documents").select("source").distinct()
    return s.select("source", scan.in_scope(F.col("source"), "src1", False).alias("exact"), scan.in_scope(F.col("source"), "src1", True).alias("below"))


@query("SELECT doc_id, length(text) > 0 AND length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g')) * 100 >= length(text) * 85 AS real_text FROM documents")
def real_text(spark, sf_dir):
    """S6 S7."""
    return load(spark, sf_dir, "documents").select("doc_id", text.is_real_text(F.col("text")).alias("real_text"))


@query(r"""WITH n AS (SELECT p_partkey, 'dir/' || replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '_' ELSE '' END) || CASE WHEN p_partkey % 4 = 0 THEN 'V' || (p_partkey % 10) || 'Final' ELSE '' END || '.md' AS path FROM part),
s AS (SELECT p_partkey, path, trim(regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)[.]md$', 1), '[-_]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')) AS context FROM n)
SELECT p_partkey, path, nullif(context, '') AS context FROM s""")
def filename_contexts(spark, sf_dir):
    """Words of file names, split at - and _ and where a capital follows a small letter or digit."""
    k = F.col("p_partkey")
    sep = F.when(k % 3 == 0, "-").when(k % 3 == 1, "_").otherwise("")
    tail = F.when(k % 4 == 0, F.concat(F.lit("V"), (k % 10).cast("string"), F.lit("Final"))).otherwise("")
    path = F.concat(F.lit("dir/"), F.replace("p_name", F.lit(" "), sep), tail, F.lit(".md"))
    return load(spark, sf_dir, "part").select(k, path.alias("path")).withColumn("context", text.filename_context(F.col("path")))


@query("WITH d AS (SELECT o_orderkey, (o_orderkey % 90 + 1) || substr('smhdwx', (o_orderkey % 6 + 1)::INT, 1) AS value FROM orders) SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 WHEN 4 THEN 604800 END * (o_orderkey % 90 + 1) AS seconds FROM d")
def durations(spark, sf_dir):
    """F14."""
    o = load(spark, sf_dir, "orders")
    value = F.concat((F.col("o_orderkey") % 90 + 1).cast("string"), F.substring(F.lit("smhdwx"), (F.col("o_orderkey") % 6 + 1).cast("int"), F.lit(1)))
    return o.select("o_orderkey", text.duration_column(value).alias("seconds"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def since_cutoff(spark, sf_dir):
    """A cutoff that reaches the scan."""
    e = load(spark, sf_dir, "events")
    cutoff = F.expr("timestamp_ntz'2024-01-31 00:00:00'") - F.make_interval(secs=F.lit(text.duration_seconds("7d")))
    return e.where(F.col("ts") >= cutoff).select("event_id", "event_type")


@query("WITH u AS (SELECT conv_id, turn, octet_length(encode(text)) AS n FROM conversations) SELECT conv_id, turn, (coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS byte_start, (sum(n) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS byte_end FROM u")
def view_layout(spark, sf_dir):
    """where each unit starts in the view of its document."""
    u = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), "text")
    return stores.view_offsets(u).select(F.col("doc").alias("conv_id"), F.col("ord").alias("turn"), "byte_start", "byte_end")


@query("WITH i AS (SELECT page_id, page_id % 5 AS unit, CASE WHEN page_id % 7 <> 0 THEN length(html)::DOUBLE END AS area FROM pages) SELECT page_id, unit FROM (SELECT *, max(area) OVER (PARTITION BY unit) AS largest FROM i) WHERE area IS NULL OR area / largest >= 0.25")
def image_areas(spark, sf_dir):
    """Images of a quarter of the unit's largest area; without a box they stay."""
    i = load(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 5).alias("unit"), F.when(F.col("page_id") % 7 != 0, F.length("html").cast("double")).alias("area"))
    return eligibility.largest_images(i).select("page_id", "unit")


@query("SELECT vec_id, round(list_sum(list_transform(h, lambda x: x * x)), 4) AS norm, round(abs(h[1]), 3) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / n) AS h FROM (SELECT vec_id, embedding[1:16]::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding[1:16]::DOUBLE[], lambda x: x * x))) AS n FROM embeddings))")
def truncated_vectors(spark, sf_dir):
    """The first 16 dimensions at unit length."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", vectors.truncated(F.col("embedding"), 16).alias("h"))
    return e.select("vec_id", F.round(vectors.dot(F.col("h"), F.col("h")), 4).alias("norm"), F.round(F.abs(F.element_at("h", 1)).cast("double"), 3).alias("first"))


@query()
def chunks(spark, sf_dir):
    """Chunks of all documents, with spans in bytes."""
    d = load(spark, sf_dir, "documents")
    rows = d.select(hashing.content_hash(F.col("text").cast("binary")).alias("raw_hash"), F.lit("p").alias("tool_profile_hash"), F.lit(1).cast("bigint").alias("gen"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("unit_key"), "text")
    return chunking.chunk(rows).select("chunk_id", "unit_key", "byte_start", "byte_end", "text_hash")


@query()
def search_texts(spark, sf_dir):
    """Normalized Markdown, its search projection and slugs of titles."""
    columns = {"markdown": (text.normalize_markdown, "text"), "projection": (text.search_projection, "markdown"), "slug": (text.slugify, "markdown")}
    d = text.computed(load(spark, sf_dir, "documents").select("doc_id", "text"), columns)
    return d.select("doc_id", F.sha2("markdown", 256).alias("markdown_sha256"), F.sha2("projection", 256).alias("projection_sha256"), "slug")


@query()
def token_embeddings(spark, sf_dir):
    """offline embeddings of benchmark passages."""
    b = load(spark, sf_dir, "benchmark").select("item_id", vectors.token_embedding_col("text").alias("v"))
    return b.select("item_id", F.size("v").alias("dimensions"), F.round(vectors.norm(F.col("v")), 4).alias("norm"))


# --- history ------------------------------------------------------------------------


def commit_tables(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    entries = e.groupBy("day", "user_id").agg(F.max_by("event_type", "event_id").alias("kind"))
    entries = entries.select(F.concat(F.lit("c-"), "day").alias("commit_hash"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), hashing.content_hash(F.col("kind")).alias("raw_hash"))
    days = e.select("day").distinct()
    w = W.orderBy("day")
    p = days.select(F.concat(F.lit("c-"), "day").alias("commit_hash"), F.concat(F.lit("c-"), F.lag("day", 1).over(w)).alias("p0"), F.when(F.row_number().over(w) % 7 == 0, F.concat(F.lit("c-"), F.lag("day", 5).over(w))).alias("p1"))
    parents = p.select("commit_hash", F.posexplode(F.array("p0", "p1")).alias("ord", "parent")).where("parent is not null").select("commit_hash", "parent", "ord")
    return entries, parents, p.agg(F.max("commit_hash").alias("commit_hash"))


HISTORY = """WITH RECURSIVE e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY ALL),
n AS (SELECT 'c-' || day AS commit_hash, 'user/' || user_id AS path, 'sha256:' || sha256(kind) AS raw_hash FROM e),
d AS (SELECT day, lag(day, 1) OVER (ORDER BY day) AS p0, lag(day, 5) OVER (ORDER BY day) AS p1, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM e)),
p AS (SELECT 'c-' || day AS commit_hash, 'c-' || p0 AS parent, 0 AS ord FROM d WHERE p0 IS NOT NULL UNION ALL SELECT 'c-' || day, 'c-' || p1, 1 FROM d WHERE k % 7 = 0 AND p1 IS NOT NULL),
head AS (SELECT max(commit_hash) AS commit_hash FROM n),
walk AS (SELECT commit_hash, 0 AS depth FROM head UNION SELECT p.parent, depth + 1 FROM walk JOIN p ON p.commit_hash = walk.commit_hash),
chain AS (SELECT commit_hash, 0 AS depth FROM head UNION SELECT p.parent, depth + 1 FROM chain JOIN p ON p.commit_hash = chain.commit_hash AND ord = 0)
"""


@query(HISTORY + "SELECT commit_hash, min(depth)::INT AS depth FROM walk GROUP BY commit_hash")
def ancestors(spark, sf_dir):
    """Every ancestor with its least distance."""
    _, parents, head = commit_tables(spark, sf_dir)
    return history.reachable(head, parents).select("commit_hash", "depth")


@query(HISTORY + "SELECT commit_hash, depth::INT AS depth FROM chain")
def first_parent_log(spark, sf_dir):
    """The chain of first parents."""
    _, parents, head = commit_tables(spark, sf_dir)
    return history.reachable(head, parents, first_parent=True).select("commit_hash", "depth")


@query(HISTORY + ", a AS (SELECT path, raw_hash AS old_hash FROM n WHERE commit_hash = 'c-2024-01-10'), b AS (SELECT path, raw_hash AS new_hash FROM n WHERE commit_hash = 'c-2024-01-20') SELECT coalesce(a.path, b.path) AS path, old_hash, new_hash, CASE WHEN old_hash IS NULL THEN 'added' WHEN new_hash IS NULL THEN 'deleted' WHEN old_hash = new_hash THEN 'unchanged' ELSE 'modified' END AS state FROM a FULL JOIN b ON a.path = b.path")
def tree_diff(spark, sf_dir):
    """Two trees compared."""
    n, _, _ = commit_tables(spark, sf_dir)
    return history.diff(n.where("commit_hash = 'c-2024-01-10'"), n.where("commit_hash = 'c-2024-01-20'"))


@query(HISTORY + ", a AS (SELECT path, raw_hash AS x FROM n WHERE commit_hash = 'c-2024-01-10'), b AS (SELECT path, raw_hash AS y FROM n WHERE commit_hash = 'c-2024-01-20') SELECT count(*) FILTER (x IS NULL) AS added, count(*) FILTER (x <> y) AS modified, count(*) FILTER (y IS NULL) AS deleted FROM a FULL JOIN b ON a.path = b.path")
def snapshot_stats(spark, sf_dir):
    """What a snapshot added, modified and deleted."""
    n, _, _ = commit_tables(spark, sf_dir)
    return history.commit_stats(history.diff(n.where("commit_hash = 'c-2024-01-10'"), n.where("commit_hash = 'c-2024-01-20'")))


@query(HISTORY + "SELECT commit_hash, path, raw_hash FROM n WHERE NOT EXISTS (SELECT 1 FROM p JOIN n m ON m.commit_hash = p.parent WHERE p.commit_hash = n.commit_hash AND m.path = n.path AND m.raw_hash = n.raw_hash)")
def introductions(spark, sf_dir):
    """H5: commits that bring a binding in."""
    n, parents, _ = commit_tables(spark, sf_dir)
    return history.introductions(n, parents, ["path", "raw_hash"])


@query(HISTORY + """, i AS (SELECT commit_hash, path, raw_hash FROM n WHERE NOT EXISTS (SELECT 1 FROM p JOIN n m ON m.commit_hash = p.parent WHERE p.commit_hash = n.commit_hash AND m.path = n.path AND m.raw_hash = n.raw_hash)),
up AS (SELECT commit_hash AS start, parent AS a FROM p UNION SELECT up.start, p.parent FROM up JOIN p ON p.commit_hash = up.a)
SELECT path, raw_hash, min(commit_hash) AS commit_hash FROM i WHERE NOT EXISTS (SELECT 1 FROM up JOIN i j ON j.commit_hash = up.a WHERE up.start = i.commit_hash AND j.path = i.path AND j.raw_hash = i.raw_hash) GROUP BY path, raw_hash""")
def canonical_introductions(spark, sf_dir):
    """The ancestor-most introduction of each binding."""
    n, parents, _ = commit_tables(spark, sf_dir)
    key = ["path", "raw_hash"]
    return history.canonical_introduction(history.introductions(n, parents, key), parents, key).select(*key, "commit_hash")


DELETED = HISTORY + ", live AS (SELECT path, raw_hash FROM n WHERE commit_hash = (SELECT commit_hash FROM head)), h AS (SELECT n.path, n.raw_hash, row_number() OVER (PARTITION BY n.path ORDER BY depth) AS nth FROM n JOIN chain USING (commit_hash) WHERE n.path NOT IN (SELECT path FROM live)) "


@query(DELETED + "SELECT path, raw_hash FROM h WHERE nth = 1")
def deleted_files(spark, sf_dir):
    """The last version of what the head no longer has."""
    n, parents, head = commit_tables(spark, sf_dir)
    live = n.join(head, "commit_hash", "left_semi")
    return history.final_deleted(history.reachable(head, parents, first_parent=True), n, live).select("path", "raw_hash")


@query(DELETED + "SELECT path, raw_hash FROM live UNION ALL SELECT path, raw_hash FROM h WHERE nth = 1 AND raw_hash NOT IN (SELECT raw_hash FROM live)")
def live_and_deleted(spark, sf_dir):
    """Deleted content that is not live elsewhere, beside what is live."""
    n, parents, head = commit_tables(spark, sf_dir)
    live = n.join(head, "commit_hash", "left_semi").select("path", "raw_hash")
    gone = history.final_deleted(history.reachable(head, parents, first_parent=True), n, live).select("path", "raw_hash")
    return history.include_deleted(live, gone, ["raw_hash"])


@query(HISTORY + "SELECT raw_hash, list_sort(list(DISTINCT path)) AS current_paths, min(path) AS smallest FROM n WHERE commit_hash = 'c-2024-01-20' GROUP BY raw_hash")
def paths_by_content(spark, sf_dir):
    """Paths of each content, and the bytewise smallest."""
    n = commit_tables(spark, sf_dir)[0].where("commit_hash = 'c-2024-01-20'")
    return history.current_paths(n).join(history.smallest_paths(n, ["raw_hash"]).withColumnRenamed("path", "smallest"), "raw_hash")


@query(HISTORY + ", pub AS (SELECT 'k' || user_id AS chunk_id, 'c-' || day AS introduction_commit FROM e), t AS (SELECT commit_hash FROM chain WHERE depth >= 10) SELECT DISTINCT chunk_id, introduction_commit FROM pub WHERE introduction_commit IN (SELECT commit_hash FROM t)")
def visible_publications(spark, sf_dir):
    """H7: what was published at a point of the past."""
    e = load(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("chunk_id"), F.concat(F.lit("c-"), F.date_format("ts", "yyyy-MM-dd")).alias("introduction_commit")).distinct()
    _, parents, head = commit_tables(spark, sf_dir)
    return history.visible_at(e, history.reachable(head, parents, first_parent=True).where("depth >= 10")).select("chunk_id", "introduction_commit")


# --- lifecycle ----------------------------------------------------------------------


def retention_tables(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    i = F.col("event_id")
    kind = F.when(i % 50 == 0, "manual").when(i % 9 == 0, "repaired").otherwise("auto")
    commits = e.select(F.lpad(i.cast("string"), 8, "0").alias("commit_hash"), kind.alias("commit_type"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.concat(F.lit("t"), F.when(i % 40 == 1, i - 1).otherwise(i).cast("string")).alias("tree_hash"), i.alias("i"))
    tip = e.agg(F.lpad(F.max("event_id").cast("string"), 8, "0").alias("commit_hash"))
    refs = tip.select(F.lit("heads/main").alias("name"), "commit_hash")
    reached = commits.where("i % 11 <> 3").select("commit_hash").crossJoin(tip.select(F.col("commit_hash").alias("start")))
    receipts = commits.where("i % 13 = 5").select("commit_hash")
    return commits.drop("i"), reached, refs, receipts


RETENTION = f"""WITH c AS (SELECT lpad(event_id::VARCHAR, 8, '0') AS commit_hash, CASE WHEN event_id % 50 = 0 THEN 'manual' WHEN event_id % 9 = 0 THEN 'repaired' ELSE 'auto' END AS commit_type, floor(epoch(ts))::BIGINT AS t, 't' || CASE WHEN event_id % 40 = 1 THEN event_id - 1 ELSE event_id END AS tree_hash, event_id AS i FROM events),
tip AS (SELECT max(commit_hash) AS tip FROM c),
k AS (SELECT commit_hash FROM c WHERE commit_type = 'repaired' AND i % 11 <> 3 ORDER BY t DESC, commit_hash LIMIT 5),
f AS (SELECT c.*, CASE WHEN i % 11 = 3 THEN 'unreachable_commit' WHEN i % 13 = 5 THEN 'already_shallow' WHEN commit_hash = tip THEN 'ref_tip' WHEN commit_type = 'manual' THEN 'protected_commit_type' WHEN commit_hash IN (SELECT commit_hash FROM k) THEN 'retained_repaired' END AS fate FROM c, tip),
a AS (SELECT *, CASE WHEN t > {NOW} THEN -1 WHEN {NOW} - t < 86400 THEN 0 WHEN {NOW} - t < 604800 THEN 1 WHEN {NOW} - t < 2419200 THEN 2 WHEN {NOW} - t < 15552000 THEN 3 END AS tier FROM f WHERE fate IS NULL AND commit_type = 'auto'),
b AS (SELECT *, row_number() OVER (PARTITION BY tier, CASE tier WHEN 1 THEN t // 3600 WHEN 2 THEN t // 86400 WHEN 3 THEN (t // 86400 + 3) // 7 ELSE 0 END ORDER BY t DESC, commit_hash) AS nth FROM a),
r AS (SELECT commit_hash, list_extract(['future_timestamp', 'retained_recent', 'retained_hourly', 'retained_daily', 'retained_weekly'], tier + 2) AS reason FROM b WHERE tier <= 0 OR nth = 1),
g AS (SELECT f.commit_hash, commit_type, t, tree_hash, i, coalesce(fate, reason, 'candidate') AS fate FROM f LEFT JOIN r USING (commit_hash)),
z AS (SELECT commit_hash, commit_type, t, tree_hash, CASE WHEN fate = 'candidate' AND bool_or(fate <> 'candidate' AND i % 13 <> 5) OVER (PARTITION BY tree_hash) THEN 'shared_tree_non_shallow' ELSE fate END AS fate FROM g)
"""


@query(RETENTION + "SELECT * FROM z")
def retention_plan(spark, sf_dir):
    """What retention keeps, and why."""
    return lifecycle.retention_plan(*retention_tables(spark, sf_dir), NOW)


@query(RETENTION + "SELECT fate, count(*) AS n FROM z WHERE fate <> 'candidate' GROUP BY fate")
def retention_reasons(spark, sf_dir):
    """A18."""
    return lifecycle.reasons(lifecycle.retention_plan(*retention_tables(spark, sf_dir), NOW))


@query(RETENTION + "SELECT count(*) AS candidates, count(DISTINCT tree_hash) AS trees, coalesce((SELECT sum(length(tree_hash)) FROM (SELECT DISTINCT tree_hash FROM z WHERE fate = 'candidate')), 0)::BIGINT AS tree_bytes FROM z WHERE fate = 'candidate'")
def retention_totals(spark, sf_dir):
    """A17."""
    commits, *rest = retention_tables(spark, sf_dir)
    trees = commits.select("tree_hash", F.length("tree_hash").cast("bigint").alias("size_bytes")).distinct()
    return lifecycle.plan_totals(lifecycle.retention_plan(commits, *rest, NOW), trees)


@query("""WITH o AS (SELECT DISTINCT ['commit', 'raw', 'chunk'][l_linenumber % 3 + 1] AS kind, 'h' || l_orderkey AS hash FROM lineitem),
p AS (SELECT 'raw' AS kind, 'h' || o_orderkey AS hash FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT 'h' || o_orderkey AS hash FROM orders WHERE o_orderkey % 10 = 0),
x AS (SELECT o.*, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.kind = o.kind AND p.hash = o.hash) THEN 'referenced' WHEN kind = 'commit' THEN 'kind_not_swept' WHEN hash IN (SELECT hash FROM r) THEN 'recently_written' ELSE 'unreferenced' END AS reason FROM o)
SELECT kind, hash, CASE reason WHEN 'referenced' THEN 'protected' WHEN 'unreferenced' THEN 'candidate' ELSE 'inventory_only' END AS class, reason FROM x""")
def orphan_inventory(spark, sf_dir):
    """Every object with its class and reason."""
    li, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    h = lambda c: F.concat(F.lit("h"), F.col(c).cast("string")).alias("hash")
    objects = li.select(F.element_at(F.array(F.lit("commit"), F.lit("raw"), F.lit("chunk")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("kind"), h("l_orderkey")).distinct()
    protected = o.where("o_orderstatus = 'O'").select(F.lit("raw").alias("kind"), h("o_orderkey"))
    return lifecycle.inventory(objects, protected, o.where("o_orderkey % 10 = 0").select(h("o_orderkey")), ("raw", "chunk"))


@query("WITH l AS (SELECT l_orderkey AS raw_hash, l_partkey AS hash FROM lineitem), t AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 0), m AS (SELECT DISTINCT hash FROM l WHERE raw_hash IN (SELECT o_orderkey FROM t)) SELECT 'part' AS kind, hash, CASE WHEN hash IN (SELECT hash FROM l WHERE raw_hash NOT IN (SELECT o_orderkey FROM t)) THEN 'preserved' ELSE 'deleted' END AS fate FROM m")
def purge_closure(spark, sf_dir):
    """What goes with purged files, and what others still use."""
    links = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("raw_hash"), F.lit("part").alias("kind"), F.col("l_partkey").alias("hash"))
    return lifecycle.purge_closure(load(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("raw_hash")), links)


@query("""WITH t AS (SELECT user_id AS raw_hash, event_id % 97 AS epoch, event_type AS event, 1 AS w FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id % 97, event_type, 0 FROM events WHERE event_id % 2 = 1)
SELECT raw_hash, epoch, event FROM (SELECT *, row_number() OVER (PARTITION BY raw_hash ORDER BY epoch DESC, w DESC, event DESC) AS k FROM t) WHERE k = 1""")
def final_events(spark, sf_dir):
    """The last event, tombstones first among equals."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("raw_hash"), (F.col("event_id") % 97).alias("epoch"), F.col("event_type").alias("event"), "event_id")
    return lifecycle.final_events(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id"))


@query("""WITH o AS (SELECT DISTINCT 'sha256:' || sha256(CASE WHEN doc_id % 50 = 0 THEN text || '!' ELSE text END) AS hash, text AS body FROM documents WHERE doc_id % 7 <> 0), r AS (SELECT 'c' || (doc_id % 3) AS commit_hash, 'sha256:' || sha256(text) AS hash FROM documents),
f AS (SELECT DISTINCT hash, 'hash_mismatch' AS finding FROM o WHERE 'sha256:' || sha256(body) <> hash UNION ALL SELECT DISTINCT hash, 'missing' FROM r WHERE hash NOT IN (SELECT hash FROM o))
SELECT f.hash, finding, coalesce(list_sort(list(DISTINCT r.commit_hash) FILTER (r.commit_hash IS NOT NULL)), []) AS commits FROM f LEFT JOIN r ON r.hash = f.hash GROUP BY f.hash, finding""")
def verified_objects(spark, sf_dir):
    """Objects whose bytes do not match, and references to none."""
    d = load(spark, sf_dir, "documents")
    stored = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    objects = d.where("doc_id % 7 <> 0").select(hashing.content_hash(stored.cast("binary")).alias("hash"), F.col("text").alias("body")).distinct()
    refs = d.select(F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("commit_hash"), hashing.content_hash(F.col("text").cast("binary")).alias("hash"))
    return lifecycle.broken_objects(objects, refs)


# --- ledger -------------------------------------------------------------------------

LEDGER = """WITH l AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS adapter, (o_totalprice * 100)::BIGINT AS usd FROM orders WHERE o_orderstatus <> 'P'),
q AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS adapter, (o_totalprice * 100)::BIGINT AS estimated_usd, o_orderkey % 4 AS state FROM orders WHERE o_orderstatus = 'P'),
a AS (SELECT month, adapter, sum(usd) AS spent FROM l GROUP BY ALL), b AS (SELECT month, adapter, sum(estimated_usd) AS reserved FROM q WHERE state IN (0, 1) GROUP BY ALL),
m AS (SELECT coalesce(a.month, b.month) AS month, coalesce(a.adapter, b.adapter) AS adapter, coalesce(spent, 0)::DOUBLE AS spent, coalesce(reserved, 0)::DOUBLE AS reserved FROM a FULL JOIN b ON a.month = b.month AND a.adapter = b.adapter)
"""


def ledger_tables(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("adapter"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("usd"), "o_orderstatus", "o_orderkey")
    spent = o.where("o_orderstatus <> 'P'")
    held = o.where("o_orderstatus = 'P'").select("month", "adapter", F.col("usd").alias("estimated_usd"), (F.col("o_orderkey") % 4).alias("state"))
    return spent, held


@query(LEDGER + "SELECT month, adapter, spent, reserved, spent + reserved AS total FROM m")
def month_totals(spark, sf_dir):
    """Spent and reserved, by month and adapter (in cents, so that sums are exact)."""
    t = ledger.month_totals(*ledger_tables(spark, sf_dir), ["adapter"])
    return t.select("month", "adapter", *[F.col(c).cast("double").alias(c) for c in ("spent", "reserved", "total")])


@query(LEDGER + ", x AS (SELECT month, adapter, spent + reserved AS total FROM m), y AS (SELECT month, sum(total) AS device FROM x GROUP BY month) SELECT x.month, adapter, CASE WHEN device + 1000 >= 100000000 THEN 'device' WHEN total + 1000 >= 40000000 THEN 'adapter' END AS denied_by FROM x JOIN y USING (month)")
def budget_decisions(spark, sf_dir):
    """Which cap denies the next request."""
    t = ledger.month_totals(*ledger_tables(spark, sf_dir), ["adapter"])
    device = F.sum("total").over(W.partitionBy("month"))
    c = t.select("month", "adapter", F.col("total").alias("adapter_total"), device.alias("device_total"), F.lit(0).alias("folder_total"), F.lit(None).cast("double").alias("folder_cap"), F.lit(4e7).alias("adapter_cap"), F.lit(1e8).alias("device_cap"), F.lit(1000.0).alias("usd"))
    return ledger.decide(c).select("month", "adapter", "denied_by")


@query("WITH l AS (SELECT c_mktsegment AS level, sum(c_acctbal) AS total, 400.0 * count(*) AS cap FROM customer GROUP BY 1) SELECT level, round(total / cap * 100, 6) AS percent FROM l WHERE total / cap * 100 >= 80 ORDER BY total / cap DESC LIMIT 1")
def budget_warning(spark, sf_dir):
    """A9."""
    levels = load(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("level")).agg(F.sum("c_acctbal").alias("total"), (F.lit(400.0) * F.count(F.lit(1))).alias("cap"))
    return ledger.budget_warning(levels).withColumn("percent", F.round("percent", 6))


@query("WITH u AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS done, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN l_orderkey % 97 = 0 OR (done = 0 AND failed > 0) THEN 'failed' WHEN done > 0 AND failed > 0 THEN 'partial' WHEN done > 0 THEN 'done' ELSE 'pending' END AS status FROM u")
def task_statuses(spark, sf_dir):
    """A10 L9."""
    u = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("done"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    return u.select("l_orderkey", ledger.task_status(F.col("done"), F.col("failed"), F.col("l_orderkey") % 97 == 0).alias("status"))


@query("WITH c AS (SELECT p_partkey, p_partkey % 5 <> 0 AS a, p_partkey % 4 <> 0 AS b, p_partkey % 3 <> 0 AS c, p_size / 100.0 AS r, p_partkey % 7 AS k FROM part), m AS (SELECT p_partkey, CASE WHEN NOT a THEN 'no_previous_done_run' WHEN NOT b THEN 'identity_changed' WHEN NOT c THEN 'adapter_lacks_incremental_update' WHEN r >= 0.30 THEN 'change_rate_threshold' WHEN k >= 5 THEN 'max_consecutive_incremental' END AS reason FROM c) SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN 'incremental' ELSE 'full' END AS mode FROM m")
def markdownize_modes(spark, sf_dir):
    """F25 A11."""
    k = F.col("p_partkey")
    c = load(spark, sf_dir, "part").select(k, (k % 5 != 0).alias("has_previous"), (k % 4 != 0).alias("raw_only"), (k % 3 != 0).alias("incremental"), (F.col("p_size") / 100.0).alias("change_rate"), (k % 7).alias("consecutive"))
    return ledger.markdownize_mode(c).select("p_partkey", "reason", "mode")


@query("WITH i AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'prune' ELSE 'poll' END AS kind, s_suppkey % 31 AS ord, s_suppkey % 50 = 7 AS own FROM supplier), n AS (SELECT count(*) FILTER (kind = 'prune' AND NOT own) AS p, count(*) FILTER (kind <> 'prune' AND NOT own) AS o FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ord, id) AS k FROM i WHERE NOT own) SELECT id, kind FROM r, n WHERE k <= CASE WHEN kind = 'prune' THEN least(p, greatest(16, 40 - o)) ELSE least(o, 40 - least(p, greatest(16, 40 - o))) END UNION ALL SELECT id, kind FROM i WHERE own")
def sweep_quota(spark, sf_dir):
    """O6."""
    k = F.col("s_suppkey")
    items = load(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 5 == 0, "prune").otherwise("poll").alias("kind"), (k % 31).alias("ord"), (k % 50 == 7).alias("own"))
    return ledger.sweep_quota(items, total=40, reserved=16).select("id", "kind")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def ledger_append(spark, sf_dir):
    """Rows whose key is new, once each."""
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    return ledger.append_once(o.where("o_orderkey % 3 = 0"), o.unionByName(o), ["o_orderkey"])


@query("SELECT event_type, count(*) AS n, count(*) FILTER (CASE event_type WHEN 'click' THEN false ELSE true END) AS retryable FROM events GROUP BY 1")
def retries_by_kind(spark, sf_dir):
    """a policy table joined by kind."""
    e = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    policy = ledger.retry_policies(spark).where("error_kind in ('auth_error', 'network_error')")
    kind = F.when(F.col("event_type") == "click", "auth_error").otherwise("network_error")
    return e.withColumn("error_kind", kind).join(F.broadcast(policy), "error_kind").select("event_type", "n", F.when(F.col("retryable"), F.col("n")).otherwise(0).alias("retryable"))


# --- stores -------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_by_key(spark, sf_dir):
    """The last record of each key of a log."""
    return stores.latest(load(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || '!' ELSE c_mktsegment END AS segment FROM customer")
def registry_upsert(spark, sf_dir):
    """S14 U7."""
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = c.where("c_custkey % 4 = 0").select("c_custkey", F.concat("segment", F.lit("!")).alias("segment"), F.lit(2).cast("bigint").alias("seq"))
    return stores.upsert(c, new.unionByName(new.withColumn("seq", F.lit(1).cast("bigint")).withColumn("segment", F.lit("old"))), ["c_custkey"])


@query("SELECT DISTINCT 'raw' AS kind, 'sha256:' || sha256(text) AS hash FROM documents WHERE 'sha256:' || sha256(text) NOT IN (SELECT 'sha256:' || sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def new_objects(spark, sf_dir):
    """Objects that the store lacks."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.lit("raw").alias("kind"), F.col("text").alias("body"))
    stored = d.where("doc_id % 2 = 0").select("kind", hashing.content_hash(F.col("body").cast("binary")).alias("hash"))
    return stores.new_objects(stored, d.drop("doc_id")).select("kind", "hash")


@query("SELECT doc_id, source AS scope_id FROM documents WHERE source IN ('src1', 'src5')")
def retained_scopes(spark, sf_dir):
    """Rows of scopes that are still there."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("scope_id"))
    return stores.retain_scopes(d, spark.createDataFrame([("src1",), ("src5",)], "scope_id string"))


@query("SELECT label, count(*) AS vectors, count(DISTINCT len(embedding) || '/' || vec_id % 3) AS profiles, coalesce(max(vec_id), 0) AS high_water FROM embeddings GROUP BY label")
def vector_counts(spark, sf_dir):
    """A1 A2 A3."""
    e = load(spark, sf_dir, "embeddings").withColumn("profile_hash", F.concat_ws("/", F.size("embedding"), F.col("vec_id") % 3))
    return stores.high_water(e, ["label"], "vec_id").select("label", F.col("n").alias("vectors"), "profiles", "high_water")


@query("WITH h AS (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS size FROM documents GROUP BY source) SELECT 'sha256:' || sha256(string_agg(source || chr(9) || n || chr(9) || size || chr(10), '' ORDER BY source)) AS generation FROM h")
def collection_generation(spark, sf_dir):
    """One hash of all scope headers in order."""
    h = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("scope_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("size"))
    return stores.generation(h)


@query("""WITH c AS (SELECT doc_id, 'h' || doc_id % 50 AS text_hash, CASE WHEN doc_id % 3 = 0 THEN 'p' ELSE 'q' END AS profile_hash, CASE WHEN doc_id % 2 = 0 THEN lang END AS context FROM documents),
e AS (SELECT DISTINCT 'h' || doc_id % 50 AS target_hash, 'p' AS profile_hash, CASE WHEN doc_id % 4 = 0 THEN lang END AS context, doc_id % 50 AS k FROM documents WHERE doc_id % 50 < 40)
SELECT c.doc_id, e.k::DOUBLE AS first FROM c JOIN e ON e.target_hash = c.text_hash AND e.profile_hash = c.profile_hash AND e.context IS NOT DISTINCT FROM c.context""")
def linked_embeddings(spark, sf_dir):
    """Vectors found by content, profile and null-safe context; other profiles and contexts stay without."""
    d = load(spark, sf_dir, "documents")
    i = F.col("doc_id")
    part = F.concat(F.lit("h"), (i % 50).cast("string"))
    rows = d.select(F.col("source").alias("scope_id"), i.cast("string").alias("chunk_id"), part.alias("text_hash"), F.when(i % 3 == 0, "p").otherwise("q").alias("profile_hash"), F.when(i % 2 == 0, F.col("lang")).alias("context"), i)
    stored = d.where("doc_id % 50 < 40").select(part.alias("target_hash"), F.lit("p").alias("profile_hash"), F.when(i % 4 == 0, F.col("lang")).alias("context"), F.array((i % 50).cast("float"), F.lit(1).cast("float")).alias("vector")).distinct()
    return stores.link_embeddings(rows, stored).where("vector is not null").select("doc_id", F.element_at("vector", 1).cast("double").alias("first"))


# --- evaluation ---------------------------------------------------------------------

GOLD = """WITH g AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || ':' || doc_id)) AS rank FROM (SELECT query_id, doc_id FROM g UNION ALL SELECT item_id, item_id + 7 FROM benchmark UNION ALL SELECT item_id, item_id + 11 FROM benchmark))
"""


def gold_tables(spark, sf_dir):
    """Passages of the benchmark, the documents that hold them, and results to judge."""
    b, d = load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents")
    g = evaluation.containing(d, b.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))).select("query_id", "doc_id")
    noise = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") + 7).alias("doc_id")).unionByName(b.select(F.col("item_id").alias("query_id"), (F.col("item_id") + 11).alias("doc_id")))
    order = F.md5(F.concat(F.col("query_id").cast("string"), F.lit(":"), F.col("doc_id").cast("string")))
    r = g.unionByName(noise).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(order)))
    wide = lambda x: x.withColumn("raw_hash", F.col("doc_id").cast("string")).withColumn("section", F.lit("")).withColumn("path", F.lit(None).cast("string"))
    return wide(g), wide(r)


@query(GOLD + ", q AS (SELECT DISTINCT query_id FROM r) SELECT q.query_id, count(DISTINCT g.doc_id) AS expected, count(DISTINCT CASE WHEN r.rank <= 2 THEN r.doc_id END) AS found, CASE WHEN count(DISTINCT g.doc_id) > 0 THEN count(DISTINCT CASE WHEN r.rank <= 2 THEN r.doc_id END)::DOUBLE / count(DISTINCT g.doc_id) ELSE 0.0 END AS recall FROM q LEFT JOIN g USING (query_id) LEFT JOIN r ON r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY q.query_id")
def recall_at_2(spark, sf_dir):
    """Recall of results against the documents that hold each passage."""
    return evaluation.recall_at_k(*gold_tables(spark, sf_dir), 2)


@query(GOLD + ", f AS (SELECT query_id, doc_id, min(rank) AS rank FROM r GROUP BY ALL) SELECT g.query_id, CASE WHEN count(f.rank) = count(*) THEN max(f.rank) END::INT AS worst_rank FROM (SELECT DISTINCT * FROM g) g LEFT JOIN f USING (query_id, doc_id) GROUP BY 1")
def worst_expected_rank(spark, sf_dir):
    """A14 E3."""
    e, r = gold_tables(spark, sf_dir)
    return evaluation.worst_rank(e, r, ["doc_id"])


@query("SELECT event_type, count(value) AS n, min(value) AS min, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY event_type")
def latency_summary(spark, sf_dir):
    """Nearest-rank percentiles."""
    return evaluation.latency_stats(load(spark, sf_dir, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("""WITH p AS (SELECT p_partkey, p_name AS truth, CASE p_partkey % 4 WHEN 0 THEN p_type || ' ' || p_name ELSE replace(replace(p_name, 'e', CASE p_partkey % 4 WHEN 1 THEN 'c' ELSE '' END), 'o', '0') || CASE p_partkey % 4 WHEN 3 THEN ' ' || p_brand ELSE '' END END AS seen FROM part),
w AS (SELECT p_partkey, truth, unnest(CASE WHEN length(seen) <= length(truth) THEN [seen] ELSE [substr(seen, i, length(truth)) FOR i IN range(1, length(seen) - length(truth) + 2)] END) AS part FROM p)
SELECT p_partkey, round(least(1.0, min(levenshtein(truth, part)) / length(truth)), 6)::DOUBLE AS cer FROM w GROUP BY p_partkey, truth""")
def character_errors(spark, sf_dir):
    """edits against the best window of what was read: the name itself, confused and lost letters, words after it."""
    k, name = F.col("p_partkey"), F.col("p_name")
    wrong = F.replace(F.replace(name, F.lit("e"), F.when(k % 4 == 1, "c").otherwise("")), F.lit("o"), F.lit("0"))
    seen = F.when(k % 4 == 0, F.concat("p_type", F.lit(" "), name)).when(k % 4 == 3, F.concat(wrong, F.lit(" "), "p_brand")).otherwise(wrong)
    return load(spark, sf_dir, "part").select(k, F.round(evaluation.character_error_rate(name, seen), 6).alias("cer"))


@query("WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS cells, p_name || p_type AS text FROM part) SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE len(list_filter(list_concat(cells, ['#none#']), lambda c: contains(text, c)))::DOUBLE / (len(cells) + 1) END AS recall, CASE WHEN p_partkey % 3 = 0 THEN 'textized' WHEN p_partkey % 2 = 0 THEN 'image_fallback' ELSE 'missing' END AS formula FROM p")
def table_recall(spark, sf_dir):
    """F21 F22 E5."""
    p = load(spark, sf_dir, "part")
    k, txt = F.col("p_partkey"), F.concat("p_name", "p_type")
    cells = F.when(k % 2 == 0, F.split("p_name", " ")).otherwise(F.concat(F.split("p_name", " "), F.array(F.lit("#none#"))))
    tokens = F.when(k % 3 == 0, F.array("p_name")).otherwise(F.array(F.lit("#none#")))
    return p.select(k, evaluation.cell_recall(cells, txt).alias("recall"), evaluation.formula_class(tokens, txt, k % 2 == 0).alias("formula"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, embedding[1:16]::DOUBLE[] AS h FROM embeddings), p AS (SELECT q.vec_id AS query_id, d.vec_id AS id, list_cosine_similarity(q.e, d.e) AS a, list_cosine_similarity(q.h, d.h) AS b FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, id) AS x, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, id) AS y FROM p)
SELECT query_id, count(*) FILTER (x <= 10 AND y <= 10) / 10.0::DOUBLE AS overlap, max(CASE WHEN x = 1 THEN id END) = max(CASE WHEN y = 1 THEN id END) AS same_first FROM k GROUP BY query_id""")
def truncation_agreement(spark, sf_dir):
    """Do 16 of 64 dimensions keep the neighbours of every hundredth row?"""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = F.col("id") % 100 == 0
    return evaluation.neighbour_agreement(evaluation.nearest(e, asked, 10), evaluation.nearest(e.withColumn("vector", F.slice("vector", 1, 16)), asked, 10), 10)


@query("WITH h AS (SELECT d.lang AS class, coalesce(l.quality, 0) = 1 AS ours, coalesce(l.toxic, 0) = 1 AS other FROM documents d JOIN labels l USING (doc_id)) SELECT class, count(*) AS n, round(avg(ours::INT), 6) AS ours, round(avg(other::INT), 6) AS other, avg(ours::INT) >= 0.8 AND avg(ours::INT) - avg(other::INT) >= 0.3 AS passes FROM h GROUP BY class")
def margin_gates(spark, sf_dir):
    """A20 E7."""
    h = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    g = evaluation.gates(h.select(F.col("lang").alias("class"), (F.coalesce("quality", F.lit(0)) == 1).alias("ours"), (F.coalesce("toxic", F.lit(0)) == 1).alias("other")))
    return g.withColumn("ours", F.round("ours", 6)).withColumn("other", F.round("other", 6))


@query("""WITH v AS (SELECT label, list_cosine_similarity(embedding::DOUBLE[], CASE WHEN label % 2 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: x * 2) ELSE list_concat((embedding::DOUBLE[])[2:], (embedding::DOUBLE[])[1:1]) END) AS c FROM embeddings)
SELECT label % 2 AS kind, count(c) AS n, round(min(c), 6) AS least, round(avg(c), 6) AS mean, CASE WHEN min(c) >= 0.999 THEN 'same_space' ELSE 'different_space' END AS verdict FROM v GROUP BY label % 2""")
def same_space(spark, sf_dir):
    """Vectors of one space up to their length, and others whose axes moved."""
    e = load(spark, sf_dir, "embeddings").withColumn("kind", F.col("label") % 2)
    other = F.when(F.col("kind") == 0, F.transform("embedding", lambda x: x * 2)).otherwise(F.concat(F.slice("embedding", 2, 10_000), F.slice("embedding", 1, 1)))
    out = evaluation.same_space(e.select("kind", vectors.rank_cosine(F.col("embedding"), other).alias("cosine")), by=["kind"])
    return out.withColumn("least", F.round("least", 6)).withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderkey AS query_id, (o_orderkey % 10 + 1)::INT AS before, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 7 + 1)::INT END AS after, CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 7 < o_orderkey % 10 THEN 'improved' WHEN o_orderkey % 6 = 0 OR o_orderkey % 7 > o_orderkey % 10 THEN 'worsened' ELSE 'same' END AS effect FROM orders")
def rerank_effects(spark, sf_dir):
    """E4."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))
    k = F.col("query_id")
    return evaluation.rerank_effect(o.select(k, (k % 10 + 1).cast("int").alias("rank")), o.where("query_id % 6 <> 0").select(k, (k % 7 + 1).cast("int").alias("rank")))


@query("""SELECT doc_id AS pointer_id, CASE WHEN source = 'src0' THEN 'registry_duplicate' WHEN source IN ('src1', 'src2') THEN 'scope_unreachable' WHEN doc_id % 11 = 0 THEN 'tombstoned' WHEN doc_id % 7 = 0 THEN 'not_found' WHEN doc_id % 5 = 0 THEN 'unverifiable' ELSE 'alive' END AS status FROM documents""")
def pointer_status(spark, sf_dir):
    """Whether citations still hold."""
    d = load(spark, sf_dir, "documents")
    i = F.col("doc_id")
    p = d.select(i.alias("pointer_id"), F.col("source").alias("scope_id"), F.lit("c1").alias("commit_hash"), F.concat(F.lit("r"), i.cast("string")).alias("raw_hash"), F.concat(F.lit("k"), i.cast("string")).alias("chunk_id"))
    names = d.where("source <> 'src1'").select("source").distinct()
    scopes = names.unionByName(names.where("source = 'src0'")).select(F.col("source").alias("scope_id"), (F.col("source") != "src2").alias("reachable"))
    commits = spark.createDataFrame([("c1",)], "commit_hash string")
    events = p.where("pointer_id % 11 = 0").select("raw_hash", F.lit("purged").alias("event"))
    status = evidence.verify(p, scopes, commits, p.where("pointer_id % 7 <> 0"), p.where("pointer_id % 5 <> 0"), events)
    return status.select("pointer_id", "status")


@query("SELECT doc_id, 'evidence://' || source || '/commit/c/chunk/k' || doc_id || '?raw=r&bytes=0-' || n_chars || '&path=a%20b%2F' || doc_id AS uri FROM documents")
def pointer_uris(spark, sf_dir):
    """F17."""
    d = load(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    return d.select("doc_id", evidence.pointer_column(F.col("source"), F.lit("c"), F.concat(F.lit("k"), i), F.lit("r"), F.lit(0), F.col("n_chars"), F.concat(F.lit("a b/"), i)).alias("uri"))


@query("WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), c AS (SELECT h, count(*) AS n, min('k' || doc_id) AS first FROM d WHERE doc_id % 3 <> 0 GROUP BY h) SELECT doc_id AS pointer_id, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN first END AS target, coalesce(n, 0) > 4 AS overflow FROM d LEFT JOIN c USING (h)")
def retargeted(spark, sf_dir):
    """Live chunks with the text of a pointer."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("pointer_id"), F.sha2("text", 256).alias("text_hash"))
    c = d.where("pointer_id % 3 <> 0").select("text_hash", F.concat(F.lit("k"), F.col("pointer_id").cast("string")).alias("chunk_id"))
    return evidence.retarget(d, c, 4).drop("text_hash")


# --- units, queues, coverage --------------------------------------------------------


@query()
def unit_mapping(spark, sf_dir):
    """Turns of a conversation against those of a later version, by fingerprint and order."""
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("unit"), F.sha2("text", 256).alias("fingerprint"))
    edited = F.when(F.col("ord") % 3 == 1, F.concat("fingerprint", F.lit("x"))).otherwise(F.col("fingerprint"))
    later = c.where("ord > 0 or doc % 2 = 0").withColumn("fingerprint", edited)
    return units.map_units(c, later)


@query("""WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS u FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE conv_id % 4 WHEN 1 THEN 'not_disjoint' WHEN 2 THEN 'not_complete' WHEN 3 THEN 'updated_unasked' END AS fault FROM c""")
def response_checks(spark, sf_dir):
    """U4: what an adapter returned, held against what was asked."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("units"))
    none, k = F.array().cast("array<bigint>"), F.col("conv_id") % 4
    r = c.select("conv_id", F.when(k == 2, F.filter("units", lambda x: x > 0)).otherwise(F.col("units")).alias("updated"), F.when(k == 1, F.slice("units", 1, 1)).otherwise(none).alias("added"), none.alias("unchanged"), none.alias("failed"), none.alias("removed"), "units", F.when(k == 3, none).otherwise(F.col("units")).alias("asked_changed"), F.when(k == 1, F.slice("units", 1, 1)).otherwise(none).alias("asked_added"), none.alias("asked_removed"))
    return units.response_faults(r).select("conv_id", "fault")


@query("SELECT p_partkey, replace(p_brand, '#', '##') || CASE WHEN k = 1 THEN '' ELSE '#' || k END AS key FROM (SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS k FROM part)")
def sheet_keys(spark, sf_dir):
    """Names that repeat get a number, a # in them is doubled."""
    return units.duplicate_suffix(load(spark, sf_dir, "part"), ["p_size"], "p_brand", "p_partkey").select("p_partkey", "key")


@query("SELECT o_orderkey AS instance_id FROM orders o WHERE o_orderkey % 2 = 0 AND (SELECT bool_and(l_linestatus = 'F') FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def promotions(spark, sf_dir):
    """Online instances all of whose units are done."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance_id"), (F.col("o_orderkey") % 2 == 0).alias("online"))
    u = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.when(F.col("l_linestatus") == "F", "done").otherwise("failed").alias("state"))
    return units.promotable(o, u).select("instance_id")


@query(f"SELECT event_id AS request_id FROM events WHERE event_id % 3 = 0 AND {NOW} - floor(epoch(ts))::BIGINT > 604800")
def stalled_requests(spark, sf_dir):
    """Reservations that were never submitted."""
    r = load(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") % 3).alias("state"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"))
    return units.stalled(r, F.lit(NOW), 604_800).select("request_id")


@query(f"SELECT event_id AS request_id FROM events WHERE event_id % 3 = 1 AND floor(epoch(ts))::BIGINT + 86400 <= {NOW - 604_800}")
def pollable_requests(spark, sf_dir):
    """Submitted requests whose next poll is due."""
    r = load(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") % 3).alias("state"), (F.unix_timestamp(F.col("ts").cast("timestamp")) + 86_400).alias("next_poll_at"))
    return units.pollable(r, F.lit(NOW - 604_800)).select("request_id")


@query("""WITH o AS (SELECT user_id AS grp, ['edited_old', 'rename', 'deleted'][event_id % 3 + 1] AS kind, event_type <> 'error' AND event_id % 5 <> 0 AS found FROM events),
k AS (SELECT grp, kind, bool_or(found) AS found, count(*) AS n FROM o GROUP BY ALL)
SELECT grp AS user_id, sum(n)::BIGINT AS n, count(*) AS kinds, bool_and(found) AS covered FROM k GROUP BY grp""")
def history_coverage(spark, sf_dir):
    """A group is covered if each kind of operation that it has is found at least once."""
    e = load(spark, sf_dir, "events")
    kind = F.element_at(F.array(F.lit("edited_old"), F.lit("rename"), F.lit("deleted")), (F.col("event_id") % 3 + 1).cast("int"))
    o = e.select(F.col("user_id").alias("group"), kind.alias("kind"), ((F.col("event_type") != "error") & (F.col("event_id") % 5 != 0)).alias("found"))
    return evaluation.coverage(o).withColumnRenamed("group", "user_id")


@query("""WITH d AS (SELECT row_number() OVER () - 1 AS i, count(*) OVER () AS n FROM documents), f AS (SELECT i % 20 AS scope, i // 20 AS file FROM d WHERE i < n // 20 * 20),
s AS (SELECT scope, file, string_agg('# Section ' || k || chr(10) || chr(10) || 'Reference ' || substr(sha256(scope || ':' || file || ':' || k), 1, 12) || ' of file ' || file || ' and section ' || k || '.' || chr(10) || chr(10), '' ORDER BY k) AS text FROM f, range(1, 31) r(k) GROUP BY scope, file)
SELECT 'scope-' || scope AS scope_id, count(*) * 30 AS chunks, sum(octet_length(encode(text)))::BIGINT AS bytes, min('sha256:' || sha256(text)) AS first_hash FROM s GROUP BY scope""")
def scale_fixture(spark, sf_dir):
    """A generated corpus of 20 scopes, with as many files as there are documents, chunked and counted by scope."""
    u = fixture.scale_units(spark, files=load(spark, sf_dir, "documents").count() // 20)
    c = chunking.chunk(u).groupBy("raw_hash").agg(F.count_distinct("chunk_id").alias("chunks"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"))
    return u.select("scope_id", "raw_hash").join(c, "raw_hash").groupBy("scope_id").agg(F.sum("chunks").alias("chunks"), F.sum("bytes").alias("bytes"), F.min("raw_hash").alias("first_hash"))


@query("SELECT s_suppkey, lower(s_name) AS key, count(*) OVER (PARTITION BY lower(s_name)) AS holders FROM supplier")
def name_collisions(spark, sf_dir):
    """names that a case-folding file system cannot tell apart."""
    s = load(spark, sf_dir, "supplier").select("s_suppkey", text.collision_key_col("s_name").alias("key"))
    return s.withColumn("holders", F.count(F.lit(1)).over(W.partitionBy("key")))


@query("SELECT source AS scope_id, count(*) AS n FROM documents WHERE source NOT IN ('src9') GROUP BY source")
def projected_scopes(spark, sf_dir):
    """Only scopes with a projection marker answer."""
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("scope_id")).where("scope_id <> 'src9'")
    markers = d.select("scope_id").distinct()
    return d.join(units.projected_or_fail(markers, d), "scope_id").groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"))
