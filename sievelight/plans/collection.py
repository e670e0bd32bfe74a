"""A collection of scopes, searched and managed through one object."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import duration_seconds, match_plan
from ..functions.vectors import token_embedding
from ..operators import chunking, eligibility, evidence, history, lifecycle, search
from ..operators.index import TextIndex
from ..sources import restore


@dataclass(frozen=True)
class Selector:
    """What time a search looks at: now, one commit, all history, or also what is deleted; since(d) implies all history."""

    at: str | None = None
    all_history: bool = False
    include_deleted: bool = False
    since: str | None = None

    def checked(self) -> Selector:
        if sum((self.at is not None, self.all_history or self.since is not None, self.include_deleted)) > 1:
            raise ValueError("selectors exclude each other")
        return Selector(self.at, self.all_history or self.since is not None, self.include_deleted, self.since and f"{duration_seconds(self.since)}s")


@dataclass
class Settings:
    max_chars: int = 6000
    depth: int = 200
    k: int = 60
    text_weight: float = 1.0
    vector_weight: float = 1.0
    lam: float = 0.7
    cap: int = 3
    mmr_depth: int = 100
    diversify: str = "mmr"
    fail_behavior: str = "fallback"
    consent: bool = True  # to send the query where its vector is made
    cursor_key: bytes = b""


@dataclass(frozen=True)
class Answer:
    """A page of rows, what was searched and why, and the token of the next page (null: there is none)."""

    rows: DataFrame
    mode: str
    reason: str | None
    cursor: str | None


@dataclass
class Collection:
    """Tables of one collection.

    chunks(scope_id, chunk_id, raw_hash, heading_path as JSON text, text, created_at, and
    seq, a number that grows as chunks are added, where pages must not see later ones),
    vectors(scope_id, chunk_id, image_id, vector), entries(scope_id, commit_hash, path,
    raw_hash), parents(scope_id, commit_hash, parent, ord), heads(scope_id,
    commit_hash), objects(kind, hash, body), purges(scope_id), profiles(scope_id,
    dimensions, distance, modality, profile_hash). ``index`` is a text index of the chunks. chunks, heads and
    purges may be functions that give the table as it is when they are called.
    """

    spark: SparkSession
    tables: dict[str, DataFrame]
    settings: Settings = field(default_factory=Settings)
    index: TextIndex | None = None
    embed: Callable[[str], list[float]] | None = None  # makes the vector of a query; by default the token embedding

    def now(self, name: str) -> DataFrame:
        """A table as it is at this moment: one that is given as a function is made anew."""
        t = self.tables[name]
        return t() if callable(t) else t

    def chunks_upto(self, mark: int | None) -> DataFrame:
        """The chunks up to a number ``seq``; all where they have none. A chunk without a number counts as old."""
        chunks = self.now("chunks")
        return chunks if mark is None else chunks.where(F.coalesce(F.col("seq") <= mark, F.lit(True)))

    def bindings(self, selector: Selector, *, heads: DataFrame | None = None, moment: datetime | None = None, mark: int | None = None) -> DataFrame:
        """scope_id, chunk_id, path, commit_hash visible to a selector: with the heads as they are or as given, at a moment (now), of chunks up to a mark (all)."""
        t, s = dict(self.tables), selector.checked()
        if heads is not None:
            t["heads"] = heads
        if s.at is not None:
            entries = t["entries"].where(F.col("commit_hash") == s.at)
        elif s.all_history:
            reach = history.reachable(t["heads"], t["parents"], by=["scope_id"])
            held, self.shallow = history.present(reach, t["entries"], by=["scope_id"])  # ancestors without a tree are skipped
            entries = held.select(*t["entries"].columns).distinct()
        else:
            entries = t["entries"].join(t["heads"], ["scope_id", "commit_hash"], "left_semi")
            if s.include_deleted:
                chain = history.reachable(t["heads"], t["parents"], first_parent=True, by=["scope_id"]).select("scope_id", "commit_hash", "depth")
                held = t["entries"].join(chain, ["scope_id", "commit_hash"]).join(entries.select("scope_id", "path"), ["scope_id", "path"], "left_anti")
                last = held.groupBy("scope_id", "path").agg(F.min_by(F.struct("commit_hash", "raw_hash"), "depth").alias("x")).select("scope_id", "x.commit_hash", "path", "x.raw_hash")
                entries = history.include_deleted(entries.select("scope_id", "commit_hash", "path", "raw_hash"), last, ["scope_id", "raw_hash"])
        chunks = self.chunks_upto(mark)
        if s.since:
            cutoff = F.current_timestamp() if moment is None else F.lit(moment)
            chunks = chunks.where(F.col("created_at") >= cutoff - F.make_interval(secs=F.lit(duration_seconds(s.since))))
        return chunks.select("scope_id", "chunk_id", "raw_hash").join(entries, ["scope_id", "raw_hash"]).select("scope_id", "chunk_id", "path", "commit_hash")

    def mode(self, asked: str) -> tuple[str, str | None]:
        """What a request searches, given the vectors, the scopes' profiles and the user's consent."""
        agree = True
        if "profiles" in self.tables:
            agree = all(r.agree for r in eligibility.profiles_agree(self.tables["profiles"].withColumn("collection_id", F.lit(0))).collect())
        return search.resolve_mode(asked, vectors_ready="vectors" in self.tables, online_allowed=self.settings.consent, agree=agree, fail_behavior=self.settings.fail_behavior)

    def search(self, query: str, **options) -> DataFrame:
        """The rows of ``answer``."""
        return self.answer(query, **options).rows

    def answer(self, query: str, *, mode: str = "auto", selector: Selector | None = None, scopes: list[str] | None = None, limit: int = 10, cursor: str | None = None, offset: int = 0) -> Answer:
        """One row per document, ranked: scope_id, chunk_id, image_id, raw_hash, score, rank, and the citation of its smallest path.

        Images rank beside chunks and take the text rank of the chunk that cites them. With
        ``cursor`` the page after the one that gave it; the token is refused if it was made for
        another query, mode, selector or set of scopes. A token also carries the heads of the first page,
        its moment, from which ``since`` is counted, the largest ``seq`` of its chunks and the version of the index,
        so that the pages of one request neither repeat nor miss a row while the collection grows. Purges are read anew.
        """
        t, c = self.tables, self.settings
        chosen = (selector or Selector()).checked()
        request = evidence.query_hash(query, [{"scope_id": s} for s in scopes or []], cap=c.cap, depth=c.mmr_depth, lam=c.lam, mode=mode, selector=repr(chosen))
        index = self.index
        if cursor is not None:
            pinned = evidence.decode_cursor(cursor, c.cursor_key, request)
            offset = pinned["consumed"]
            if index is not None and index.manifest.version != pinned["index"]:
                index = TextIndex(self.spark, index.path, pinned["index"])
        else:
            rows_of_heads = self.now("heads").select("scope_id", "commit_hash").distinct().orderBy("scope_id", "commit_hash").collect()  # one a scope
            seen = self.now("chunks")
            mark = seen.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] if "seq" in seen.columns else None
            pinned = {"heads": [list(r) for r in rows_of_heads], "moment": datetime.now(UTC).isoformat(), "mark": mark, "index": None if index is None else index.manifest.version}
        moment = datetime.fromisoformat(pinned["moment"])
        heads = self.spark.createDataFrame([tuple(h) for h in pinned["heads"]], "scope_id string, commit_hash string")
        bindings = self.bindings(chosen, heads=heads, moment=moment, mark=pinned["mark"])
        if scopes is not None:
            bindings = bindings.where(F.col("scope_id").isin(scopes))
        if "purges" in t:
            bindings = search.without_purged(bindings, self.now("purges"))
        all_chunks = self.chunks_upto(pinned["mark"])
        eligible = bindings.select("scope_id", "chunk_id").distinct()
        resolved, reason = self.mode(mode)
        phrases, short = match_plan(query)

        def text_lane() -> DataFrame:
            corpus = all_chunks.select("scope_id", "chunk_id", "heading_path", "text")
            if not phrases:
                return search.short_lane(corpus, short, eligible, c.depth)
            return search.bm25(corpus, phrases, eligible, c.depth) if index is None else index.bm25(phrases, eligible, c.depth)

        def vector_lane() -> DataFrame:
            return search.vector_lane(t["vectors"], self.embed(query) if self.embed else token_embedding(query).tolist(), eligible, c.depth)

        makers = [text_lane] * (resolved != "vector") + [vector_lane] * (resolved != "text")
        lanes = search.together(self.spark, *makers, depth=c.depth)
        ranked = lanes[0] if len(lanes) == 1 else search.fuse(*lanes, k=c.k, text_weight=c.text_weight, vector_weight=c.vector_weight)
        if "score" not in ranked.columns:
            ranked = ranked.withColumn("score", -F.col("bm25") if "bm25" in ranked.columns else F.col("cosine"))
        if "image_id" not in ranked.columns:
            ranked = ranked.withColumn("image_id", F.lit(None).cast("string"))
        rows = ranked.select("scope_id", "chunk_id", "image_id", "score", "rank").join(all_chunks.select("scope_id", "chunk_id", "raw_hash"), ["scope_id", "chunk_id"])
        if "vectors" in t and c.diversify == "mmr":
            v = t["vectors"].select("scope_id", "chunk_id", F.col("image_id").alias("of_image"), "vector")
            same = (rows["scope_id"] == v["scope_id"]) & (rows["chunk_id"] == v["chunk_id"]) & rows["image_id"].eqNullSafe(v["of_image"])
            rows = rows.join(v, same, "left").select(*[rows[x] for x in rows.columns], "vector")
            rows = search.diversify(rows, lam=c.lam, depth=c.mmr_depth, most=c.cap).drop("vector")
        elif c.diversify != "off":
            rows = search.cap_per_document(rows, c.cap)
        documents = search.page(search.group_documents(rows), offset, limit + 1)
        if "purges" in t:
            documents = search.without_purged(documents, self.now("purges"))  # a purge may have begun meanwhile
        cite = bindings.groupBy("scope_id", "chunk_id").agg(F.min(F.struct("path", "commit_hash")).alias("cite"))
        found = documents.join(cite, ["scope_id", "chunk_id"]).select("scope_id", "chunk_id", "image_id", "raw_hash", "score", "rank", "cite.path", "cite.commit_hash")
        found = search.settled(found, limit + 1)  # a page and one row more
        more = found.where(F.col("rank") > offset + limit).count() > 0
        token = evidence.encode_cursor({k: pinned[k] for k in ("heads", "moment", "mark", "index")} | {"query_hash": request, "consumed": offset + limit}, c.cursor_key) if more else None
        return Answer(found.where(F.col("rank") <= offset + limit), resolved, reason, token)

    def ingest(self, units: DataFrame) -> DataFrame:
        """Chunks of new units that the collection does not have yet."""
        fresh = chunking.chunk(units, self.settings.max_chars)
        return fresh.dropDuplicates(["chunk_id"]).join(self.tables["chunks"].select("chunk_id"), "chunk_id", "left_anti")

    def history_of(self, scope_id: str) -> DataFrame:
        """Every binding (path, raw_hash) that a scope's head reaches, with its canonical introduction."""
        mine = {k: self.tables[k].where(F.col("scope_id") == scope_id).drop("scope_id") for k in ("heads", "parents", "entries")}
        return history.all_bindings(mine["heads"], mine["parents"], mine["entries"], ["path", "raw_hash"])

    def log(self, scope_id: str) -> DataFrame:
        head = self.tables["heads"].where(F.col("scope_id") == scope_id)
        return history.reachable(head, self.tables["parents"].where(F.col("scope_id") == scope_id), first_parent=True).select("commit_hash", "depth")

    def diff(self, old: str, new: str) -> DataFrame:
        e = self.tables["entries"]
        return history.diff(e.where(F.col("commit_hash") == old), e.where(F.col("commit_hash") == new))

    def snapshot(self, head: str, working: DataFrame) -> DataFrame:
        """Counts of what a commit of ``working`` (path, raw_hash) would change."""
        return history.commit_stats(history.diff(self.tables["entries"].where(F.col("commit_hash") == head), working))

    def gc_plan(self, commits: DataFrame, refs: DataFrame, receipts: DataFrame, now: int) -> DataFrame:
        reached = history.reachable(refs.select("commit_hash"), self.tables["parents"])
        return lifecycle.retention_plan(commits, reached, refs, receipts, now)

    def purge_plan(self, targets: DataFrame, links: DataFrame) -> DataFrame:
        return lifecycle.purge_closure(targets, links)

    def verify_objects(self, references: DataFrame) -> DataFrame:
        return lifecycle.broken_objects(self.tables["objects"], references)

    def verify(self, pointers: DataFrame, scopes: DataFrame, commits: DataFrame, events: DataFrame) -> DataFrame:
        t = self.tables
        return evidence.verify(pointers, scopes, commits, t["entries"], t["chunks"], events)

    def restore(self, hashes: DataFrame, folder: str) -> DataFrame:
        """Write objects (hash, name) to a new folder."""
        return restore.restore(self.tables["objects"].join(hashes, "hash").select("hash", "name", "body"), folder)
