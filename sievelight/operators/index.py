"""A written index for phrase search, kept in segments: positions of trigrams, and lengths of chunks.

Postings lie in runs of some chunks each, sorted by trigram, so that a filter on trigrams reaches
the pages that hold them and a query reads what its phrases need, not the texts; they are written where
they are made, without a shuffle. Of a chunk's rows of a trigram one leads, which is counted. A trigram is a number of three
code points. Phrases are found where all their trigrams stand in a row.

An index is a row of versions. A version's manifest names its segments, its deletions and
what they add up to; it is written last and never changed. Appending writes a segment of the
new chunks alone, deleting writes the numbers of the chunks that go, and compaction puts
segments together from their postings. A reader keeps the version it opened.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import file_system, publish_version, read_file, read_version, shared_folder, write_new_file
from .search import B, HEADING_WEIGHT, K1, KEY, TEXT_WEIGHT, eligible_rows, top

TEXT, HEADING = 0, 1
#: Row groups of postings, small enough to be skipped one by one; bytes of texts that are cut into trigrams at once.
GROUP_BYTES, PART_BYTES = 1 << 20, 4 << 20
#: Characters of texts whose postings a task sorts at once, and rows that it hands over at once.
RUN_BYTES, BATCH_ROWS = 8 << 20, 1 << 16
#: Chunks with a hit, by their trigrams' counts, up to which a query's scores are summed up on the driver: three numbers each.
FEW_HITS = 50_000
#: Candidates that are broadcast, a long each; more are joined as the planner sees fit.
BROADCAST_DOCS = 1_000_000
#: A chunk's number: the segment it came with, its partition there, its place in that.
PLACES, PARTS = 28, 12
DOCS = "doc bigint, scope_id string, chunk_id string, raw_hash string, size double, part bigint"
POSTINGS = "gram bigint, doc bigint, size int, field int, positions array<int>, leads boolean"
_open: dict[tuple[str, str], TextIndex] = {}


def grams_of(text: str) -> np.ndarray:
    """The trigrams of a text in order, as numbers."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return (x[:-2] << 42 | x[1:-1] << 21 | x[2:]) if len(x) > 2 else np.empty(0, np.int64)


def postings_of(docs: DataFrame) -> DataFrame:
    """POSTINGS of lower-case texts and headings (doc, size, text, heading), in runs sorted by trigram, of RUN_BYTES of texts each; a chunk's stand in one run."""

    def run_of(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram, doc, size, kind, long, places = (np.concatenate(x) for x in zip(*found, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(long)].astype(np.int32)), pa.array(places))
        order = np.argsort(gram, kind="stable")  # chunks come one after the other
        gram, doc = gram[order], doc[order]
        leads = np.r_[True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])]
        for k in range(0, len(order), BATCH_ROWS):
            some = slice(k, k + BATCH_ROWS)
            arrays = [gram[some], doc[some], size[order[some]], kind[order[some]]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), lists.take(pa.array(order[some])), pa.array(leads[some])], ["gram", "doc", "size", "field", "positions", "leads"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        read = 0
        for whole in batches:
            step = max(1, min(1000, PART_BYTES * whole.num_rows // max(1, whole.nbytes)))
            for k in range(0, whole.num_rows, step):
                for doc, size, *texts in zip(*(whole.slice(k, step).column(c).to_pylist() for c in ("doc", "size", "text", "heading")), strict=True):
                    for kind, text in zip((TEXT, HEADING), texts, strict=True):
                        g = grams_of(text or "")
                        read += len(g)
                        if len(g):
                            order = np.argsort(g, kind="stable")
                            kinds, first = np.unique(g[order], return_index=True)
                            n = len(kinds)
                            found.append((kinds, np.full(n, doc, np.int64), np.full(n, size, np.int32), np.full(n, kind, np.int32), np.diff(np.r_[first, len(g)]), order.astype(np.int32)))
                    if read >= RUN_BYTES:
                        yield from run_of(found)
                        found, read = [], 0
        if found:
            yield from run_of(found)

    return docs.select("doc", "size", "text", "heading").mapInArrow(run, POSTINGS)


def one_of(column: str, values: list[int]) -> Column:
    """column IN values, as equalities: the Parquet reader makes a range of a longer list and then skips nothing."""
    out = F.lit(False)
    for v in values:
        out = out | (F.col(column) == v)
    return out


def phrase_hits(rows: DataFrame, wanted: list[tuple[int, int, int]], lengths: list[int]) -> DataFrame:
    """(doc, size, f0, f1, ...) of chunks that hold a phrase, from the postings of its trigrams; ``wanted`` has (phrase, place in it, trigram)."""
    n = len(lengths)
    of_gram: dict[int, list[tuple[int, int]]] = {}
    for phrase, at, gram in wanted:
        of_gram.setdefault(gram, []).append((phrase, at))

    def counted(t: pa.Table) -> pa.RecordBatch:
        gram, doc, kind, size = (t.column(c).to_numpy() for c in ("gram", "doc", "field", "size"))
        lists = t.column("positions").combine_chunks()
        places, long = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(doc)), long)
        docs, number = np.unique(doc, return_inverse=True)
        sums = np.zeros((n, len(docs)))
        starts: list[list[np.ndarray]] = [[] for _ in lengths]
        for g, uses in of_gram.items():
            mine = gram[row] == g
            for phrase, at in uses:
                # document, field and place where the phrase would begin, as one number
                starts[phrase].append(((number[row[mine]] << 1 | kind[row[mine]]) << 32) + places[mine] - at)
        for i, s in enumerate(starts):
            keys, times = np.unique(np.concatenate([np.empty(0, np.int64), *s]), return_counts=True)
            keys = keys[times == lengths[i]] >> 32  # all trigrams stand in a row
            sums[i] = TEXT_WEIGHT * np.bincount(keys[keys & 1 == TEXT] >> 1, minlength=len(docs)) + HEADING_WEIGHT * np.bincount(keys[keys & 1 == HEADING] >> 1, minlength=len(docs))
        held = sums.any(axis=0)
        sizes = np.zeros(len(docs), np.int32)
        sizes[number] = size
        return pa.RecordBatch.from_arrays([pa.array(docs[held]), pa.array(sizes[held].astype(np.float64)), *(pa.array(s[held]) for s in sums)], ["doc", "size", *(f"f{i}" for i in range(n))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
                last = int(np.searchsorted(t.column("doc").to_numpy(), t.column("doc")[-1].as_py(), "left"))
                left = t.slice(last)  # the last document may go on
                if last:
                    yield counted(t.slice(0, last))
        if left is not None:
            yield counted(left)

    sums = ", ".join(f"f{i} double" for i in range(n))
    return rows.select("gram", "doc", "size", "field", "positions").repartition("doc").sortWithinPartitions("doc").mapInArrow(run, f"doc bigint, size double, {sums}")


@dataclass
class Manifest:
    """segments: name, origins (numbers of the segments whose chunks it has), chunks, size; deletions: name, docs, size. Sums are exact whole numbers."""

    version: int = 0
    next: int = 0
    segments: list[dict] = field(default_factory=list)
    deletions: list[dict] = field(default_factory=list)


class TextIndex:
    """One version of an index below a folder. ``docs`` has DOCS, ``postings`` POSTINGS, ``grams`` gram and docs, of all its segments; deleted chunks are left out of ``docs`` and of every answer."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        self.manifest = Manifest(**(read_version(spark, path, version) or {}))
        m = self.manifest
        read = lambda name, ddl, some: spark.read.schema(ddl).parquet(*[f"{path}/{kind}/{s['name']}{name}" for kind, s in some]) if some else spark.createDataFrame([], ddl)
        segments = [("segments", s) for s in m.segments]
        self.postings = read("/postings", POSTINGS, segments)
        self.grams = read("/grams", "gram bigint, docs bigint", segments)
        self.deleted = read("", "doc bigint, size double", [("deletions", d) for d in m.deletions])
        self.deletions = sum(d["docs"] for d in m.deletions)
        self.docs = self._live(self._docs_of(m.segments))
        self.chunks = sum(s["chunks"] for s in m.segments) - self.deletions
        total = sum(s["size"] for s in m.segments) - sum(d["size"] for d in m.deletions)
        self.mean = total / self.chunks if self.chunks else 0.0
        self.known: dict[int, int] = {}

    def _docs_of(self, segments: list[dict]) -> DataFrame:
        """Chunks of some segments, deleted ones too; folders of partitions are read one segment at a time."""
        each = [self.spark.read.schema(DOCS).parquet(f"{self.path}/segments/{s['name']}/docs") for s in segments]
        return functools.reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], DOCS)

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self.deletions:
            return rows
        gone = self.deleted.select("doc")
        return rows.join(F.broadcast(gone) if self.deletions <= BROADCAST_DOCS else gone, "doc", "left_anti")

    def _published(self, manifest: Manifest) -> TextIndex:
        """The next version, unless another writer was first."""
        manifest.version = self.manifest.version + 1
        publish_version(self.spark, self.path, vars(manifest))
        return TextIndex(self.spark, self.path, manifest.version)

    @classmethod
    def build(cls, corpus: DataFrame, path: str) -> TextIndex:
        """The first version of the index of ``corpus`` (scope_id, chunk_id, raw_hash, heading_path, text)."""
        return cls(corpus.sparkSession, path).append(corpus)

    def _segment(self, corpus: DataFrame, origin: int) -> dict:
        name = f"{origin:08d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path}/segments/{name}"
        size = F.greatest(F.lit(0), F.length("text") - 2) + F.greatest(F.lit(0), F.length("heading_path") - 2)
        lowered = corpus.select(*KEY, "raw_hash", F.coalesce(size, F.lit(0)).alias("size"), F.lower("text").alias("text"), F.lower("heading_path").alias("heading"))
        parts = min(1 << PARTS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        place = F.monotonically_increasing_id()  # the partition above bit 33, the place in it below
        row, part = place.bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright(place, 33)
        row = F.when(row < 1 << PLACES, row).otherwise(F.raise_error(F.lit("too many chunks in a partition: raise spark.sql.shuffle.partitions")).cast("bigint"))
        part = F.lit(origin << PARTS) + part
        lowered.repartition(parts, *KEY).withColumns({"part": part, "doc": F.shiftleft(part, PLACES) + row}).write.parquet(f"{at}/texts")
        texts = self.spark.read.parquet(f"{at}/texts")
        texts.select("doc", *KEY, "raw_hash", F.col("size").cast("double").alias("size"), "part").write.partitionBy("part").parquet(f"{at}/docs")
        self._written(postings_of(texts), at)
        fs, path = file_system(self.spark, at)
        fs.delete(path(f"{at}/texts"), True)
        return self._described(name, [origin])

    def _written(self, postings: DataFrame, at: str) -> None:
        """Postings as they come, and in how many chunks each trigram is: sums of what tasks count."""
        postings.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{at}/postings")
        grams = self.spark.read.schema(POSTINGS).parquet(f"{at}/postings").groupBy("gram").agg(F.count_if("leads").alias("docs"))
        grams.sortWithinPartitions("gram").write.parquet(f"{at}/grams")

    def _described(self, name: str, origins: list[int]) -> dict:
        total = self.spark.read.schema(DOCS).parquet(f"{self.path}/segments/{name}/docs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("size")).first()
        return {"name": name, "origins": origins, "chunks": total.n, "size": int(total.size)}

    def _gone(self, keys: DataFrame) -> list[dict]:
        """A written deletion of the live chunks with these keys; none where there is no such chunk. Reads keys of chunks, not texts."""
        if not self.manifest.segments:
            return []
        name = uuid.uuid4().hex
        self.docs.join(keys.select(*KEY).distinct(), KEY, "left_semi").select("doc", "size").write.parquet(f"{self.path}/deletions/{name}")
        total = self.spark.read.schema("doc bigint, size double").parquet(f"{self.path}/deletions/{name}").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("size")).first()
        return [{"name": name, "docs": total.n, "size": int(total.size)}] if total.n else []

    def append(self, rows: DataFrame) -> TextIndex:
        """The version with ``rows`` too; chunks of the same scope and id that it had are replaced. Only ``rows`` are read for their texts."""
        m = self.manifest
        segment = self._segment(rows, m.next)
        return self._published(Manifest(0, m.next + 1, [*m.segments, segment] if segment["chunks"] else m.segments, m.deletions + self._gone(rows)))

    def delete(self, keys: DataFrame) -> TextIndex:
        """The version without the chunks of these keys (scope_id, chunk_id)."""
        m = self.manifest
        return self._published(Manifest(0, m.next, m.segments, m.deletions + self._gone(keys)))

    def compact(self, *, whole: bool = False) -> TextIndex:
        """The version in which every segment has more chunks than all smaller ones together, so that there are a logarithmic number; with ``whole`` there is one.

        Segments are put together from their postings, without what is deleted of them.
        """
        m = self.manifest
        by_size = sorted(m.segments, key=lambda s: (s["chunks"], s["name"]))
        merged, total = 0, 0
        for k, s in enumerate(by_size):
            if k and s["chunks"] <= total:
                merged = k + 1
            total += s["chunks"]
        some = by_size if whole else by_size[:merged]
        if len(some) < 2 and not (whole and m.deletions):
            return self
        origins = sorted({o for s in some for o in s["origins"]})
        name = f"{m.next:08d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path}/segments/{name}"
        self._live(self._docs_of(some)).write.partitionBy("part").parquet(f"{at}/docs")
        self._written(self._live(self.spark.read.schema(POSTINGS).parquet(*[f"{self.path}/segments/{s['name']}/postings" for s in some])).sortWithinPartitions("gram", "doc", "field"), at)
        left = []
        if self.deletions:  # of segments that stay
            kept = f"{uuid.uuid4().hex}"
            origin = F.shiftright("doc", PLACES + PARTS)
            self.deleted.where(~origin.isin(origins)).coalesce(1).write.parquet(f"{self.path}/deletions/{kept}")
            sums = self.spark.read.schema("doc bigint, size double").parquet(f"{self.path}/deletions/{kept}").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("size")).first()
            left = [{"name": kept, "docs": sums.n, "size": int(sums.size)}] if sums.n else []
        stay = [s for s in m.segments if s not in some]
        return self._published(Manifest(0, m.next + 1, [*stay, self._described(name, origins)], left))

    def vacuum(self) -> int:
        """Delete segments and deletions that this version does not have, and older manifests; readers of older versions must be done. Returns how many went."""
        fs, at = file_system(self.spark, self.path)
        keep = {"segments": {s["name"] for s in self.manifest.segments}, "deletions": {d["name"] for d in self.manifest.deletions}, "manifests": {f"{self.manifest.version:012d}"}}
        gone = 0
        for kind, names in keep.items():
            folder = at(f"{self.path}/{kind}")
            for f in fs.listStatus(folder) if fs.exists(folder) else []:
                if f.getPath().getName() not in names:
                    gone += fs.delete(f.getPath(), True)
        return gone

    @classmethod
    def of(cls, spark: SparkSession, corpus: Callable[[], DataFrame], name: str) -> TextIndex:
        """The index of a corpus, built where there is none; ``name`` changes whenever the corpus does.

        It is built in a folder of its own, which a small file of the index's name points to: the
        first builder to write that file wins, and one that dies leaves none.
        """
        key = (spark.sparkContext.applicationId, name)
        if key not in _open:
            base = shared_folder(spark)
            pointer = f"{base}/index-{name}"
            fs, at = file_system(spark, base)
            if not fs.exists(at(pointer)) or not read_file(spark, pointer).endswith(b"\n"):
                own = f"index-{name}-{uuid.uuid4().hex}"
                cls.build(corpus(), f"{base}/{own}")
                if not write_new_file(spark, pointer, f"{own}\n".encode()):
                    if read_file(spark, pointer).endswith(b"\n"):
                        fs.delete(at(f"{base}/{own}"), True)
                    else:  # its writer is about to finish, or died
                        _open[key] = cls(spark, f"{base}/{own}")
                        return _open[key]
            _open[key] = cls(spark, f"{base}/{read_file(spark, pointer).decode().strip()}")
        return _open[key]

    def docs_with(self, grams: list[int]) -> dict[int, int]:
        """How many chunks, deleted ones too, hold each trigram; what was asked once is remembered."""
        new = [g for g in grams if g not in self.known]
        if new:
            if len(self.known) > 100_000:
                self.known.clear()
            found: dict[int, int] = {}
            for r in self.grams.where(one_of("gram", new)).collect():  # a row for each trigram and segment
                found[r.gram] = found.get(r.gram, 0) + r.docs
            self.known.update({g: found.get(g, 0) for g in new})
        return {g: self.known.get(g, 0) for g in grams}

    def _hits(self, phrases: list[str]) -> tuple[DataFrame, int]:
        """``counts``, and a bound on its number of rows."""
        grams = [grams_of(p.lower()).tolist() for p in phrases]
        if any(not g for g in grams):
            raise ValueError("a phrase has three characters at least")
        known = self.docs_with(sorted({x for g in grams for x in g}))
        wanted = [(i, at, g) for i, gs in enumerate(grams) if all(known[g] for g in gs) for at, g in enumerate(gs)]
        if not wanted:
            return self.spark.createDataFrame([], "doc bigint, size double, " + ", ".join(f"f{i} double" for i in range(len(phrases)))), 0
        rare = {i: min(grams[i], key=lambda g: known[g]) for i, _, _ in wanted}
        most = sum(known[g] for g in rare.values())
        every = {g for _, _, g in wanted}
        rows = self.postings.where(one_of("gram", sorted(every)))
        if sum(known[g] for g in every) > max(8 * most, FEW_HITS):  # only chunks with the rarest trigram of a phrase can hold it
            able = self.postings.where(one_of("gram", sorted(set(rare.values())))).select("doc")
            rows = rows.join(F.broadcast(able) if most <= BROADCAST_DOCS else able, "doc", "left_semi")
        return self._live(phrase_hits(rows, wanted, [len(g) for g in grams])), most

    def counts(self, phrases: list[str]) -> DataFrame:
        """(doc, size, f0, f1, ...): weighted occurrences of each phrase, of chunks that hold any."""
        return self._hits(phrases)[0]

    def _looked_up(self, scored: DataFrame, parts: list[int] | None) -> DataFrame:
        """Scores with the keys of their chunks; ``parts`` of the numbering in which these lie."""
        docs = self.docs if parts is None else self.docs.where(F.col("part").isin(parts))
        return docs.drop("size", "part").join(F.broadcast(scored) if parts is not None else scored, "doc")

    def bm25(self, phrases: list[str], eligible: DataFrame | None = None, depth: int = 200) -> DataFrame:
        """As ``search.bm25``: the ``depth`` best chunks for phrases OR-ed together, with raw_hash beside.

        Statistics are those of all live chunks. Where no more than FEW_HITS chunks can hold a
        phrase, scores are summed up on the driver and only the chunks within the cut are looked up; otherwise all in Spark.
        """
        hits, most = self._hits(phrases)
        n = len(phrases)
        if most > FEW_HITS:
            held = hits.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(n)])
            scored = hits.crossJoin(F.broadcast(held)).select("doc", self._score([(F.col(f"n{i}"), F.col(f"f{i}")) for i in range(n)], F.col("size")).alias("bm25"))  # one row of statistics
            return top(eligible_rows(self._looked_up(scored, None), eligible).select(*KEY, "raw_hash", "bm25"), depth, "bm25", *KEY)
        t = hits.toArrow()
        doc, size = t.column("doc").to_numpy(), t.column("size").to_numpy()
        score = np.zeros(len(doc))
        for i in range(n):
            f = t.column(f"f{i}").to_numpy()
            with_it = int((f > 0).sum())
            idf = np.log((self.chunks - with_it + 0.5) / (with_it + 0.5))
            score -= (idf if idf > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / (self.mean or 1.0)))
        if eligible is None and len(doc) > depth:
            cut = np.partition(score, depth - 1)[depth - 1] if depth else -np.inf
            doc, score = doc[score <= cut], score[score <= cut]  # with ties
        scored = self.spark.createDataFrame(pa.table({"doc": doc, "bm25": score}), "doc bigint, bm25 double")
        found = self._looked_up(scored, np.unique(doc >> PLACES).tolist())
        return top(eligible_rows(found, eligible).select(*KEY, "raw_hash", "bm25"), depth, "bm25", *KEY)

    def _score(self, terms: list[tuple[Column, Column]], size: Column) -> Column:
        score = F.lit(0.0)
        for n, f in terms:
            idf = F.log((F.lit(self.chunks) - n + 0.5) / (n + 0.5))
            idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
            score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.lit(self.mean or 1.0)))
        return score


def state_of(spark: SparkSession, *paths: str) -> str:
    """A name for the present state of files, in folders at any depth: their paths, sizes and times."""
    out = hashlib.sha256()
    for p in paths:
        fs, at = file_system(spark, p)
        files, found = fs.listFiles(at(p), True), []
        while files.hasNext():
            f = files.next()
            found.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
        out.update(repr((p, sorted(found))).encode())
    return out.hexdigest()[:24]
