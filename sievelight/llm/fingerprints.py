"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs, the pieces between line feeds. Every paragraph is
hashed to a wide vector, and a text's fingerprint is the sum of these vectors, each lane
modulo a power of two. So the order of paragraphs doesn't matter, equal multisets have equal
fingerprints, and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has two groups of lanes. Those modulo 2^64 are pseudo-random in every bit and tell
multisets apart. Those modulo 2^16 add up a sign for each window of sixteen bytes of the
paragraph, at a lane that the window chooses, so that texts which share windows have
fingerprints that are near each other: the squared length of a difference is, on average, the
number of windows by which two texts differ. That gives a likeness of fingerprints alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_kept, slices, table

#: Lanes modulo 2^64, lanes modulo 2^16, bytes of a window, and bytes of text that are worked on at once.
WIDE, NEAR, WINDOW, STEP = 16, 256, 16, 1 << 20
#: Odd multipliers of the windows' hash and of the wide lanes: of the golden ratio and of its powers.
GOLDEN = 0x9E3779B97F4A7C15
SALTS = np.array([pow(GOLDEN, k, 1 << 64) | 1 for k in range(1, WIDE + 1)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, every bit made to depend on all of them."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(GOLDEN)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(30))


def near_sums(hashes: np.ndarray) -> np.ndarray:
    """Per lane the sum of the signs of windows with these hashes."""
    lane = (hashes & np.uint64(NEAR - 1)).astype(np.int64)
    sign = (hashes >> np.uint64(63)).astype(np.int64) * 2 - 1
    return np.bincount(lane, weights=sign, minlength=NEAR).astype(np.int64)


def windows_of(text: bytes) -> np.ndarray:
    """Near lanes of all windows of a text that lie within one paragraph, a step of bytes at a time."""
    out = np.zeros(NEAR, np.int64)
    for at in range(0, max(0, len(text) - WINDOW + 1), STEP):
        b = np.frombuffer(text[at : at + STEP + WINDOW - 1], np.uint8)
        if len(b) < WINDOW:
            break
        eight = np.zeros(len(b) - 7, np.uint64)
        for k in range(8):
            eight |= b[k : len(b) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
        ends = np.concatenate([[0], np.cumsum(b == 10)])
        inside = ends[WINDOW:] == ends[:-WINDOW]
        pairs = mixed(eight[:-8] * np.uint64(GOLDEN) ^ mixed(eight[8:]))
        out += near_sums(pairs[inside])
    return out


def vector(text: bytes) -> np.ndarray:
    """The fingerprint of a text as unsigned lanes: the sum of the vectors of its paragraphs."""
    pieces = text.split(b"\n")
    wide = np.zeros(WIDE, np.uint64)
    for i in range(0, len(pieces), 4096):
        digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces[i : i + 4096])), "<u8").reshape(-1, 2)
        wide += mixed(digest[:, :1] * SALTS[None] ^ mixed(digest[:, 1:] + SALTS[None])).sum(axis=0, dtype=np.uint64)
    short = np.array([xxhash.xxh3_64_intdigest(p) for p in pieces if 0 < len(p) < WINDOW], np.uint64)
    near = windows_of(text) + near_sums(mixed(short))
    return np.concatenate([wide, (near & 0xFFFF).astype(np.uint64)])


def added(*vectors: np.ndarray) -> np.ndarray:
    """The fingerprint of all the paragraphs together."""
    return reduced(np.sum(vectors, axis=0, dtype=np.uint64))


def removed(whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The fingerprint without the paragraphs of ``part``."""
    return reduced(whole - part)


def reduced(lanes: np.ndarray) -> np.ndarray:
    out = lanes.copy()
    out[WIDE:] &= np.uint64(0xFFFF)
    return out


def written(lanes: np.ndarray) -> str:
    """A fingerprint as text: its lanes' bytes in base 64."""
    return base64.b64encode(lanes[:WIDE].astype("<u8").tobytes() + lanes[WIDE:].astype("<u2").tobytes()).decode()


def read(text: str) -> np.ndarray:
    raw = base64.b64decode(text)
    return np.concatenate([np.frombuffer(raw[: 8 * WIDE], "<u8"), np.frombuffer(raw[8 * WIDE :], "<u2").astype(np.uint64)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, about 0 for texts without a common window; between, the estimate of 2 <a, b> / (|a|^2 + |b|^2) over counts of windows."""
    if np.array_equal(a, b):
        return 1.0
    signed = lambda x: x[WIDE:].astype(np.uint16).view(np.int16).astype(np.float64)
    x, y, apart = signed(a), signed(b), signed(a - b)
    size = float((x * x).sum() + (y * y).sum())
    return min(1.0, max(0.0, 1 - float((apart * apart).sum()) / size)) if size else 0.0


def edited(text: str, after: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


KEY = ["last", "id", "twin"]


def keyed(docs: DataFrame) -> DataFrame:
    """Place in the order of documents (null ids last, then by text hash) and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.col("doc_id").cast("bigint")
    return docs.select(own.isNull().cast("int").alias("last"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(text).alias("twin"), text.alias("text"))


def range_heads(docs: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """The first document of each of about even ranges of the order; as many as there are ranges come to the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in batches:
            if b.num_rows:
                yield b.slice(0, 1)
                for _ in batches:
                    pass

    places = docs.select(*KEY).repartitionByRange(ranges, *KEY).sortWithinPartitions(*KEY)
    return sorted(tuple(r) for r in places.mapInArrow(first, "last int, id bigint, twin bigint").collect())


def neighbours(docs: DataFrame, ranges: int) -> DataFrame:
    """Every distinct (place, text) with the number ``n`` of its rows, dealt to ranges and sorted in them; the first document of the next range (of the first, for the last) ends each range, marked ``halo``.

    Texts are shuffled once. Rows that repeat an id and a text are counted before the shuffle,
    within each part of a batch, so that a group of any size stays small.
    """
    heads = range_heads(docs, ranges)
    columns = [np.array([h[k] for h in heads], np.int64) for k in range(3)]
    starts = {h: k for k, h in enumerate(heads)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in slices(batches):
            counts: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(*(b.column(c).to_pylist() for c in KEY), strict=True)):
                counts.setdefault(key, [row, 0])[1] += 1
            rows = []
            for key, (row, n) in counts.items():
                low, high = 0, len(heads)
                for c, x in zip(columns, key, strict=True):
                    low, high = low + int(np.searchsorted(c[low:high], x, "left")), low + int(np.searchsorted(c[low:high], x, "right"))
                at = low if low < high else low - 1
                rows.append((row, at, 0, n))
                if key in starts:
                    rows.append((row, (starts[key] - 1) % len(heads), 1, 1))
            take, at, halo, n = zip(*rows, strict=True) if rows else ((), (), (), ())
            own = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(halo, pa.int32()), pa.array(n, pa.int64()), *(own.column(c) for c in (*KEY, "text"))], ["at", "halo", "n", *KEY, "text"])

    dealt = docs.mapInArrow(deal, "at int, halo int, n bigint, last int, id bigint, twin bigint, text string")
    return dealt.repartitionById(max(1, len(heads)), "at").sortWithinPartitions("at", "halo", *KEY)


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per row of the sorted ranges but the halos: each document meets the one after it."""
    drop_kept()
    before = None  # the document that waits for the next: key, text, its fingerprint, its number of rows
    out: list[tuple] = []

    def answer(doc: tuple, text: str, lanes: np.ndarray, after: str, after_lanes: np.ndarray, times: int) -> None:
        if times:
            new = edited(text, after)
            raw = new.encode()
            new_lanes = lanes if new == text else vector(raw)
            row = (None if doc[0] else doc[1], len(text), hashlib.sha256(raw).hexdigest(), written(lanes), written(new_lanes), likeness(lanes, new_lanes), likeness(lanes, after_lanes))
            out.extend([row] * times)

    def flushed() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        columns = zip(*out, strict=True) if out else ((),) * len(kinds)
        names = [c.split()[0] for c in RESULT.split(", ")]
        got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        out.clear()
        return got

    for b in slices(batches):
        for at, halo, n, last, i, twin, value in zip(*(b.column(c).to_pylist() for c in ("at", "halo", "n", *KEY)), b.column("text"), strict=True):
            key = (last, i, twin)
            if before and not halo and before[0] == key:
                before[3] += n
                continue
            if halo and not before:
                continue  # a second halo of the range
            text = value.as_py()
            lanes = before[2] if before and before[1] == text else vector(text.encode())
            if before:
                # all but the last of a document's rows are followed by their like
                answer(before[0], before[1], before[2], before[1], before[2], before[3] - 1)
                answer(before[0], before[1], before[2], text, lanes, 1)
            before = None if halo else [key, text, lanes, n]
            if len(out) > 2000:
                yield flushed()
    yield flushed()


def fingerprints(docs: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, fingerprint, and the fingerprint, hash and likeness of an edited text, of every row of ``docs`` (doc_id, text).

    The edited text has the first as many code points of the next document in place of its
    last floor(n_chars / 2). The next document is that of the next id; null ids come last, rows of one id
    are ordered by their text's hash, rows that repeat both one after the other; after the
    last comes the first, so a single document is its own next one. Null texts are empty. An
    empty text is one empty paragraph. Texts of any length are read whole. Other columns,
    whatever their names, are not read. An empty table gives no rows.

    ``ranges`` (the number of shuffle partitions) parts of the order are worked on side by side.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return neighbours(keyed(docs), ranges).mapInArrow(with_edits, RESULT)


def changed(prints: DataFrame, changes: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fingerprint) after insertions and deletions of paragraphs, without reading any other text.

    ``changes`` has doc_id, paragraph and times: 1 inserts the paragraph once, -1 deletes it
    once, any other whole number so often. Lanes of one document are summed by task before they
    are shuffled. A document that ``prints`` lacks begins without a paragraph; one that has no
    change passes through. Null paragraphs and null times change nothing; a null id is an id.
    ``prints`` has one row per id.
    """

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in slices(batches):
            sums: dict[int | None, np.ndarray] = {}
            for i, p, times in zip(b.column("doc_id").to_pylist(), b.column("paragraph").to_pylist(), b.column("times").to_pylist(), strict=True):
                if "\n" in p:
                    raise ValueError("a paragraph has no line feed")
                add = vector(p.encode()) * np.uint64(times % (1 << 64))
                sums[i] = sums[i] + add if i in sums else add
            ids = [i for i in sums for _ in range(WIDE + NEAR)]
            values = np.concatenate(list(sums.values())) if sums else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(range(WIDE + NEAR)) * len(sums), pa.int32()), pa.array((values >> np.uint64(32)).astype(np.int64)), pa.array((values & np.uint64(0xFFFFFFFF)).astype(np.int64))], ["doc_id", "lane", "high", "low"])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in slices(batches):
            out = []
            for old, high, low in zip(b.column("fingerprint").to_pylist(), b.column("highs").to_pylist(), b.column("lows").to_pylist(), strict=True):
                now = read(old) if old else np.zeros(WIDE + NEAR, np.uint64)
                if high:
                    now = reduced(now + (np.array(high, np.int64).astype(np.uint64) << np.uint64(32)) + np.array(low, np.int64).astype(np.uint64))
                out.append(written(now))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    asked = changes.where("paragraph is not null and times is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "paragraph", F.col("times").cast("bigint").alias("times"))
    sums = asked.mapInArrow(lanes, "doc_id bigint, lane int, high bigint, low bigint").groupBy("doc_id", "lane").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    in_order = F.array_sort(F.collect_list(F.struct("lane", "high", "low")))  # as many as a fingerprint has lanes
    sums = sums.groupBy("doc_id").agg(in_order.alias("s")).select(F.col("doc_id").alias("of"), F.col("s.high").alias("highs"), F.col("s.low").alias("lows"))
    old = prints.select(F.col("doc_id").cast("bigint").alias("doc_id"), "fingerprint")
    both = old.join(sums, old["doc_id"].eqNullSafe(sums["of"]), "full").select(F.coalesce("doc_id", "of").alias("doc_id"), "fingerprint", "highs", "lows")
    return both.mapInArrow(applied, "doc_id bigint, fingerprint string")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of ``documents``.

    Nulls, empty and very long texts, null and repeated ids, repeated rows, an empty table and
    other columns: see ``fingerprints``.
    """
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
