"""Near-duplicates by the Jaccard similarity of word shingles, found by SimHash tiles.

Texts with one set of shingles collapse first. A set's fingerprint has 256 bits, four words
of 64. Sets of similarity s have a cosine of 2 s / (1 + s) at least, hence at 0.8 a bit
differs with probability 0.15 (0.19 for sets of four or five); unrelated sets differ in half
of the bits. Sets are dealt into blocks by size, since no set is similar to one that is
smaller than the share asked for; the first words of two blocks are compared in tiles as
in ``simhash``, and what lies within ``NEAR`` bits there and within ``WIDE`` bits in all
is a candidate. A similar pair is missed with probability 1e-4 at most for the smallest sets
and 1e-7 for others. Candidates of a pair of blocks then meet with their whole sets, and only
pairs whose similarity is exactly as asked become links; those that other links have
joined already are not looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, materialize, release, slices, unused
from .graph import components
from .simhash import Forest, block_pairs, deal, shingle_hashes, sided, tile_hits

WORDS, NEAR, WIDE = 4, 26, 74
MIX = np.random.default_rng(42).integers(0, 2**64, (WORDS, 2), dtype=np.uint64) | np.uint64(1)
#: Sizes of sets within a bucket differ by this factor at most.
STEP = 1.05
#: Columns of a matrix of memberships.
WIDTH = 8192


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; none where there is no word."""
    return np.unique(np.array(shingle_hashes(text, shingle), dtype=np.uint64))


def name(values: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(values.tobytes(), 42)


def wide_fingerprint(values: np.ndarray) -> np.ndarray:
    """256 bits of a set: each is 1 if set in over half of the mixed hashes."""
    out = np.zeros(WORDS, dtype=np.uint64)
    for w, (a, b) in enumerate(MIX):
        total = np.zeros(64, dtype=np.int64)
        for i in range(0, len(values), 1 << 14):
            mixed = (values[i : i + (1 << 14)] ^ b) * a
            mixed ^= mixed >> np.uint64(31)
            mixed *= b
            mixed ^= mixed >> np.uint64(29)
            total += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out[w] = np.packbits(total * 2 > len(values), bitorder="little").view("<u8")[0]
    return out


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def listed(arrays: list[np.ndarray]) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, twin (the text's hash), node (names the set of shingles), size of the set and fp (its fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in slices(batches):
            sets = [shingles(t.as_py(), shingle) for t in b.column("text").cast(pa.large_binary())]
            columns = [b.column("doc_id"), b.column("twin"), signed([name(s) for s in sets]), pa.array(list(map(len, sets)), pa.int64()), listed([wide_fingerprint(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "twin", "node", "size", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("twin"), "text").mapInArrow(run, "doc_id bigint, twin bigint, node bigint, size bigint, fp array<bigint>")


def whole_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node and values (the set itself) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in slices(batches):
            sets = [shingles(t.as_py(), shingle) for t in b.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([signed([name(s) for s in sets]), listed(sets)], ["node", "values"])

    return docs.select("text").mapInArrow(run, "node bigint, values array<bigint>")


def hits(a: np.ndarray, b: np.ndarray | None, a_size: np.ndarray, b_size: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of fingerprints (n, WORDS) of two blocks, or of one with itself."""
    other = a if b is None else b
    for x, y in tile_hits(a[:, 0].copy(), None if b is None else b[:, 0].copy(), NEAR):
        wide = np.bitwise_count(a[x] ^ other[y]).sum(axis=1) <= WIDE
        x, y = x[wide], y[wide]
        fits = np.minimum(a_size[x], b_size[y]) >= least * np.maximum(a_size[x], b_size[y]) - 1e-6
        if fits.any():
            yield x[fits], y[fits]


class Sets:
    """Sets as one array of values, for the sizes of many intersections at once."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        self.values, self.starts, self.sizes = values, starts, np.diff(starts)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.starts[i] : self.starts[i + 1]]

    def shared(self, x: np.ndarray, y: np.ndarray, other: Sets) -> np.ndarray:
        """How many values each pair has in common; few pairs one by one, many by a matrix product over the values of ``x``."""
        if len(x) <= 256:
            return np.array([len(np.intersect1d(self.of(i), other.of(j), assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], dtype=np.int64)
        out = np.zeros(len(x), dtype=np.int64)
        rows, at = np.unique(x, return_inverse=True)
        for i in range(0, len(rows), 32):
            mine = np.flatnonzero((at >= i) & (at < i + 32))
            some = [self.of(r) for r in rows[i : i + 32]]
            words, own_place = np.unique(np.concatenate(some), return_inverse=True)
            own_row = np.repeat(np.arange(len(some)), [len(v) for v in some])
            cols, to = np.unique(y[mine], return_inverse=True)
            for j in range(0, len(cols), 512):
                here = (to >= j) & (to < j + 512)
                theirs = [other.of(c) for c in cols[j : j + 512]]
                flat, owner = np.concatenate(theirs), np.repeat(np.arange(len(theirs)), [len(t) for t in theirs])
                place = np.searchsorted(words, flat)
                place[place == len(words)] = 0
                known = words[place] == flat
                place, owner = place[known], owner[known]
                total = np.zeros((len(some), len(theirs)), dtype=np.int64)
                for k in range(0, len(words), WIDTH):  # columns of the incidence matrices
                    left, right = (np.zeros((n, WIDTH), dtype=np.float32) for n in (len(some), len(theirs)))
                    for matrix, r, c in ((left, own_row, own_place), (right, owner, place)):
                        inside = (c >= k) & (c < k + WIDTH)
                        matrix[r[inside], c[inside] - k] = 1
                    total += (left @ right.T).astype(np.int64)
                out[mine[here]] = total[at[mine[here]] - i, to[here] - j]
        return out


def verified(a: Sets, b: Sets | None, a_fp: np.ndarray, b_fp: np.ndarray | None, least: float) -> Forest:
    """The components that exact links of the candidates make; members of ``b`` are numbered after those of ``a``."""
    other, shift = (a, 0) if b is None else (b, len(a.sizes))
    forest = Forest(len(a.sizes) + (0 if b is None else len(b.sizes)))
    for x, y in hits(a_fp, b_fp, a.sizes, other.sizes, least):
        for i in range(0, len(x), 1 << 14):
            p, q = x[i : i + (1 << 14)], y[i : i + (1 << 14)]
            open_ = forest.apart(p, q + shift)
            p, q = p[open_], q[open_]
            if len(p):
                both = a.shared(p, q, other)
                near = both / (a.sizes[p] + other.sizes[q] - both) >= least
                forest.link(p[near], q[near] + shift)
    return forest


def roots(docs: DataFrame, nodes: DataFrame, shingle: int, least: float, block: int, load: int) -> DataFrame:
    """(node, root) of every node that a similarity of ``least`` or more links to another, as a written table.

    ``nodes`` has node, size, fp and the doc_id of a row that holds the set. Blocks have
    about ``block`` sets and ``load`` values at most.
    """
    spark = docs.sparkSession
    bucket = F.floor(F.log("size") / math.log(STEP)).cast("int").alias("bucket")
    sizes = nodes.where("size > 0").groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.sum("size").alias("load"))
    cells = sizes.orderBy("bucket").collect()  # by powers of STEP, so a few hundred at most
    dealt = deal([max(r.n, -(-r.load * block // load)) for r in cells], block)
    near = [(i, j) for i in range(len(cells)) for j in range(i, len(cells)) if cells[j].low * least <= cells[i].high + 1e-6]
    where = spark.createDataFrame([(r.bucket, *d) for r, d in zip(cells, dealt, strict=True)], "bucket int, first int, parts int")
    placed = nodes.where("size > 0").select("node", "size", "fp", bucket).join(F.broadcast(where), "bucket")
    placed = placed.select(F.struct("node", "size", "fp").alias("member"), (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("block"))
    blocks = placed.groupBy("block").agg(F.collect_list("member").alias("members"))
    met = blocks.join(sided(block_pairs(spark, dealt, near)), "block").select("a", "b", "side", "members")

    def fps_of(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, WORDS)

    def compare(t: pa.Table) -> pa.Table:
        sides = {s: m.values for s, m in zip(t.column("side").to_pylist(), t.column("members").combine_chunks(), strict=True)}
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        out = {"node": [], "side": []}
        if 0 in sides and (a == b or 1 in sides):
            pick = lambda s, k: sides[s].field(k)
            last = 0 if a == b else 1
            found = [np.zeros(len(sides[s]), bool) for s in (0, last)]
            size = [pick(s, "size").to_numpy(zero_copy_only=False) for s in (0, last)]
            for x, y in hits(fps_of(pick(0, "fp")), None if a == b else fps_of(pick(1, "fp")), *size, least):
                found[0][x] = True
                found[1][y] = True
            if a == b:
                found = [found[0] | found[1]]
            for s, f in enumerate(found):
                out["node"] += pick(s, "node").to_numpy(zero_copy_only=False)[f].tolist()
                out["side"] += [s] * int(f.sum())
        n = len(out["node"])
        return pa.table({"a": pa.array([a] * n, pa.int32()), "b": pa.array([b] * n, pa.int32()), "side": pa.array(out["side"], pa.int32()), "node": pa.array(out["node"], pa.int64())})

    found = materialize(met.groupBy("a", "b").applyInArrow(compare, "a int, b int, side int, node bigint"))
    wanted = found.select("node").distinct()
    holders = nodes.join(wanted, "node", "left_semi").select("holder").distinct()
    held = docs.join(holders, docs["doc_id"].cast("bigint").eqNullSafe(holders["holder"]), "left_semi").select("text")
    sets = materialize(whole_sets(held, shingle).join(wanted, "node", "left_semi").dropDuplicates(["node"]))

    def check(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = t.column("side").to_numpy()
        both, ids = [], []
        for s in (0, 1):
            mine = t.filter(pa.array(side == s))
            lists = mine.column("values").combine_chunks()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            starts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))].astype(np.int64)
            both.append(Sets(flat, starts))
            ids.append(mine.column("node").to_numpy())
        fps = [np.array([wide_fingerprint(s.of(i)) for i in range(len(s.sizes))], dtype=np.uint64).reshape(-1, WORDS) for s in both]
        alone = not len(both[1].sizes)
        forest = verified(both[0], None if alone else both[1], fps[0], None if alone else fps[1], least)
        x, y = forest.stars(np.concatenate(ids))
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    links = found.join(sets, "node").groupBy("a", "b").applyInArrow(check, "a bigint, b bigint")
    out = components(links)
    release(found, sets)
    return out


def first_of_each(docs: DataFrame, *, shingle: int = 5, least: float = 0.8, block: int = 4096, load: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without near-duplicates: of each component the row of the smallest id (null last), then text hash.

    Texts are lower-cased in A-Z only and cut into the set of their runs of ``shingle``
    words; a shorter text is one run, and texts without words (null, empty, blank) equal
    each other. Texts whose sets have a Jaccard similarity of ``least`` or more are linked.
    Rows with a null id, and rows that repeat an id with another text, are documents of
    their own; rows that repeat id and text are one. Very long texts fill blocks of few
    sets. Other columns pass through, whatever their names. An empty table stays empty.
    """
    signs = materialize(signatures(docs, shingle))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("kept"), F.col("twin").alias("twin"))
    nodes = materialize(signs.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.min(place).alias("first")).withColumn("holder", F.col("first.kept")))
    linked = roots(docs, nodes, shingle, least, block, load)
    id_, twin, mine = unused(docs, "kept_id", "kept_twin", "text_hash")
    firsts = nodes.select("node", "first").join(linked, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    kept = firsts.select(F.col("first.kept").alias(id_), F.col("first.twin").alias(twin))
    rows = docs.withColumn(mine, F.xxhash64("text"))
    same = rows["doc_id"].cast("bigint").eqNullSafe(kept[id_]) & (rows[mine] == kept[twin])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", mine]).drop(mine)
