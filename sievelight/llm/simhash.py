"""Near-duplicates by SimHash, compared exactly in tiles.

Documents with one fingerprint collapse first. The distinct fingerprints are dealt
into blocks of bounded size in the order of their population counts (of the upper
and of the lower half). Two fingerprints within the radius differ by no more than
the radius in the sum of both counts' differences, so pairs of blocks, and pairs of
tiles inside blocks, whose counts lie further apart are skipped without being read.
The others are compared whole with exclusive-or and bit counts in numpy. A task
returns stars of its local components, never all pairs, so that groups of any size
cost no more rows than they have members.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_kept, materialize, slices, table
from .graph import components

#: Elements of one comparison in numpy; its temporaries stay in the cache.
STRIP = 1 << 17


def shingle_hashes(text: bytes | None, shingle: int) -> list[int]:
    """The hashes of a text's shingles, repeats included; a shorter text is one shingle, no word gives none."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, 42)]
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return [h(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text in UTF-8; 0 where there is no word."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in slices(batches):
            texts = b.column("text").cast(pa.large_binary())
            out = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def tile_hits(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, of ``a`` with ``b``, or of ``a`` with itself (each pair once)."""
    half = lambda x: (np.bitwise_count(x >> np.uint64(32)).astype(np.int16), np.bitwise_count(x & np.uint64(0xFFFFFFFF)).astype(np.int16))
    other = a if b is None else b
    (ah, al), (bh, bl) = half(a), half(other)
    orders = np.lexsort((al, ah)), np.lexsort((bl, bh))
    cuts = [np.flatnonzero(np.r_[True, (np.diff(h[o]) != 0) | (np.diff(lo[o]) != 0)]) for h, lo, o in ((ah, al, orders[0]), (bh, bl, orders[1]))]
    tiles = [np.split(o, c[1:]) for o, c in zip(orders, cuts, strict=True)]
    heads_h, heads_l = bh[[t[0] for t in tiles[1]]], bl[[t[0] for t in tiles[1]]]
    for k, rows in enumerate(tiles[0]):
        near = np.flatnonzero(np.abs(heads_h - ah[rows[0]]) + np.abs(heads_l - al[rows[0]]) <= radius)
        if b is None:
            near = near[near >= k]
        if not len(near):
            continue
        cols = np.concatenate([tiles[1][t] for t in near])
        values = other[cols]
        for j in range(0, len(cols), 4096):
            col, val = cols[j : j + 4096], values[j : j + 4096]
            step = max(1, STRIP // len(col))
            for i in range(0, len(rows), step):
                row = rows[i : i + step]
                near_by = np.flatnonzero(np.bitwise_count(a[row][:, None] ^ val[None, :]) <= radius)
                if len(near_by):
                    x, y = row[near_by // len(col)], col[near_by % len(col)]
                    if b is None:
                        x, y = x[x != y], y[x != y]
                    if len(x):
                        yield x, y


class Forest:
    """Components of the numbers below n under links that come in arrays; a root is its component's smallest number."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs are not known to be in one component."""
        return self.parent[x] != self.parent[y]

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        differ = self.apart(x, y)
        if not differ.any():
            return
        for u, v in set(zip(self.parent[x[differ]].tolist(), self.parent[y[differ]].tolist(), strict=True)):
            u, v = self.find(u), self.find(v)
            if u != v:
                self.parent[max(u, v)] = min(u, v)
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up

    def stars(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of the components: each value with that of its root."""
        linked = np.flatnonzero(self.parent != np.arange(len(values)))
        return values[linked], values[self.parent[linked]]


def stars(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the local components: each value with its component's smallest."""
    values = a if b is None else np.concatenate([a, b])
    forest = Forest(len(values))
    for x, y in tile_hits(a, b, radius):
        forest.link(x, y + (0 if b is None else len(a)))
    return forest.stars(values)


def deal(cells: list[int], block: int) -> list[tuple[int, int]]:
    """Blocks of about ``block`` rows for cells of the given sizes, in order: (first block, number of blocks) of each cell. Small neighbours share one."""
    out, last, filled = [], -1, block
    for n in cells:
        of = max(1, -(-n // block))
        if of > 1 or filled + n > block:
            last, filled = last + of, 0
        filled = block if of > 1 else filled + n
        out.append((last - of + 1, of))
    return out


def block_pairs(spark: SparkSession, dealt: list[tuple[int, int]], near: Iterable[tuple[int, int]]) -> DataFrame:
    """Pairs of blocks (a <= b) of the pairs of cells in ``near``. The driver sees cells, of which there is a fixed number at most; blocks are paired by the executors."""
    ranges = sorted({(*dealt[i], *dealt[j]) for i, j in near})
    blocks = lambda of: F.explode(F.sequence(F.col(f"{of}_first"), F.col(f"{of}_first") + F.col(f"{of}_parts") - 1))
    cells = spark.createDataFrame(ranges, "x_first int, x_parts int, y_first int, y_parts int")
    both = cells.select("*", blocks("x").alias("x")).select("x", blocks("y").alias("y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def sided(pairs: DataFrame) -> DataFrame:
    """(a, b, side, block): each pair once for either of its blocks, once for a block with itself."""
    return pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("block")).unionByName(pairs.where("a < b").select("a", "b", F.lit(1).alias("side"), F.col("b").alias("block")))


def links(fps: DataFrame, radius: int = 4, block: int = 65_536) -> DataFrame:
    """Links (a, b) among the distinct values ``fps.fp`` that connect all that lie within the radius of each other."""
    spark = fps.sparkSession
    cell = [F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo")]
    cells = sorted((r.hi + r.lo, r.hi, r.lo, r.n) for r in fps.select(*cell).groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).collect())  # 33 x 33 at most
    if not cells:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    dealt = deal([c[3] for c in cells], max(4096, min(block, -(-sum(c[3] for c in cells) // 16))))
    at = np.array([c[1:3] for c in cells], dtype=np.int16)
    near = np.argwhere(np.triu(np.abs(at[:, None] - at[None]).sum(axis=2) <= radius))
    where = spark.createDataFrame([(hi, lo, *d) for (_, hi, lo, _), d in zip(cells, dealt, strict=True)], "hi int, lo int, first int, parts int")
    b = fps.select("fp", *cell).join(F.broadcast(where), ["hi", "lo"])
    b = b.groupBy((F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).alias("block")).agg(F.collect_list("fp").alias("fps"))
    pairs = b.join(sided(block_pairs(spark, dealt, near.tolist())), "block")

    def run(t: pa.Table) -> pa.Table:
        sides = dict(zip(t.column("side").to_pylist(), t.column("fps").combine_chunks(), strict=True))
        as_array = lambda x: x.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if 0 not in sides or (1 not in sides and t.column("a")[0].as_py() != t.column("b")[0].as_py()):
            x = y = np.empty(0, np.uint64)  # the other block is empty
        else:
            x, y = stars(as_array(sides[0]), as_array(sides[1]) if 1 in sides else None, radius)
        return pa.table({"a": pa.array(x.view(np.int64)), "b": pa.array(y.view(np.int64))})

    return pairs.select("a", "b", "side", "fps").groupBy("a", "b").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, shingle: int = 4, radius: int = 4, block: int = 65_536) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    Texts are lower-cased in A-Z only and cut into shingles of ``shingle`` words,
    repeats included; shorter texts are one shingle, and texts without words (null,
    empty, blank) have fingerprint zero and link like any other. component_id is the
    smallest id that links of at most ``radius`` differing bits reach. Rows that
    repeat an id each keep their fingerprint; null ids take part, and name a
    component (as null) only if it has no other. Other columns are ignored.
    """
    d = materialize(fingerprints(docs, shingle))
    fps = materialize(d.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comps = components(links(fps, radius, block))
    named = fps.join(comps, fps["fp"] == comps["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    least = named.where("linked").groupBy("root").agg(F.min("first").alias("least"))
    to = named.join(least, "root", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return d.join(to, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``documents``: four words a shingle, four bits.

    Null, empty and blank texts have fingerprint zero and link like any other; texts of any
    length are read whole; repeated rows and ids stay rows of their own; a null id names a
    component only where it has no other; an empty table gives no rows; columns other than
    doc_id and text are not read.
    """
    return near_duplicates(table(spark, sf_dir, "documents"))
